"""Files of JSON lines as a data source, for tables and streams, and the check of their rows against a schema.

``JsonLines`` reads lines with the file and the byte they begin at. A table's files are cut into byte ranges, each a task; a
line belongs to the range it begins in. A stream's offset is how far each file has been read, which is always the end of a
line, so a line that is still being written is read once, when it is whole. ``checked`` makes an entity's columns of the lines, in the JVM, and
says of each line that is no such object what is wrong with it, so that no line is lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

from ravelin.sources.readers import DEFAULTS, SCHEMAS

SCHEMA = "file string, at long, line string"


def file_system(path: str):
    """The file system and the path in it of a path or URI that driver and tasks share."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of the files in a folder but those whose names begin with _ or a dot, as Spark has it."""
    from pyarrow import fs

    store, where = file_system(path)
    info = store.get_file_info(where)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(where, recursive=True)) if info.type == fs.FileType.Directory else []
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _lines(path: str, part: Range, block: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a range: a batch for each block of bytes and what its last line needs beyond it."""
    store, _ = file_system(path)
    with store.open_input_file(part.file) as f:
        at = part.start
        if at:  # a line that began before the range is another's
            f.seek(at - 1)
            at, held = _after_line(f, at - 1, block)
        else:
            held = b""
        while at < part.end:
            f.seek(at + len(held))
            more = f.read(block)
            held += more
            last = not more
            cut = len(held) if last else held.rfind(b"\n") + 1
            places, lines, begin = [], [], 0
            while begin < cut and at + begin < part.end:
                end = held.find(b"\n", begin)
                end = cut if end < 0 else end
                places.append(at + begin)
                lines.append(held[begin:end].removesuffix(b"\r").decode("utf-8", "replace"))
                begin = end + 1
            if lines:
                yield pa.record_batch([pa.array([part.file] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["file", "at", "line"])
            if last:
                return
            at, held = at + begin, held[begin:]


def _after_line(f, at: int, block: int) -> tuple[int, bytes]:
    """The byte behind the next line feed from ``at`` on, or the file's end."""
    while True:
        f.seek(at)
        more = f.read(block)
        found = more.find(b"\n")
        if found >= 0 or not more:
            return at + (found + 1 if found >= 0 else 0), b""
        at += len(more)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("splitBytes", 32 << 20))

    def partitions(self) -> list[Range]:
        return [Range(f, s, min(s + self.bytes, size)) for f, size in _files(self.path) for s in range(0, size, self.bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from _lines(self.path, partition)


def _whole(path: str, file: str, size: int, block: int = 1 << 16) -> int:
    """The end of the last whole line of a file."""
    store, _ = file_system(path)
    with store.open_input_file(file) as f:
        while size > 0:
            start = max(0, size - block)
            f.seek(start)
            found = f.read(size - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            size = start
    return 0


class _StreamReader(DataSourceStreamReader):
    """Offsets are {file: bytes read}; they grow by an entry for each file."""

    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("splitBytes", 32 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: _whole(self.path, f, size) for f, size in _files(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(f, s, min(s + self.bytes, to)) for f, to in sorted(end.items()) for s in range(start.get(f, 0), to, self.bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _lines(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing is deleted: files stay with their owner."""


class JsonLines(DataSource):
    """Options: path (a file or a folder), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def lines(spark: SparkSession, path: str, *, stream: bool = False, split_bytes: int = 32 << 20) -> DataFrame:
    """file, at, line of all lines below ``path``."""
    spark.dataSource.register(JsonLines)
    return (spark.readStream if stream else spark.read).format("json_lines").option("splitBytes", split_bytes).load(path)


def _kinds(kind: DataType) -> tuple[str, ...]:
    """What ``schema_of_variant`` may say of a value of a type."""
    if isinstance(kind, StringType):
        return ("STRING",)
    if isinstance(kind, BooleanType):
        return ("BOOLEAN",)
    if isinstance(kind, IntegerType | LongType):
        return ("BIGINT",)
    if isinstance(kind, DoubleType | FloatType):
        return ("BIGINT", "DECIMAL", "DOUBLE")
    return ("ARRAY",) if isinstance(kind, ArrayType) else ("OBJECT",)


def checked(rows: DataFrame, entity: str, required: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (with ``line``) with the columns of an entity and ``error``.

    ``error`` is null, or ``malformed`` (no JSON), ``not an object``, ``missing x`` for the first of ``required`` that is not there or null, or ``type x``
    for the first field with a value of another type or beyond it; then the entity's columns are null. A field that is missing has its
    default, one that is null stays null. Blank lines are no rows. Columns of ``rows`` must have other names than those of the entity.
    """
    kinds = StructType.fromDDL(SCHEMAS[entity])
    defaults = DEFAULTS.get(entity, {})
    given = rows.where(F.rlike("line", F.lit(r"\S"))).withColumn("_v", F.try_parse_json("line"))
    kind = F.schema_of_variant("_v")

    def value(name: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", "variant")

    def wrong(name: str, of: DataType) -> Column:
        at, as_type = F.schema_of_variant(value(name)), F.try_variant_get("_v", f"$.{name}", of.simpleString())
        fits = F.exists(F.array(*map(F.lit, _kinds(of))), lambda k: at.startswith(k)) & as_type.isNotNull()
        return F.when(at.isNotNull() & (at != "VOID") & ~fits, F.lit(f"type {name}"))

    known = lambda name: F.coalesce(F.schema_of_variant(value(name)), F.lit("VOID")) != "VOID"
    missing = [F.when(~known(n), F.lit(f"missing {n}")) for n in required]
    error = F.coalesce(
        F.when(F.col("_v").isNull(), "malformed"), F.when(~kind.startswith("OBJECT"), "not an object"), *missing, *(wrong(f.name, f.dataType) for f in kinds),
    )
    out = given.withColumn("error", error)
    names = F.json_object_keys("line")

    def column(name: str, of: DataType) -> Column:
        read = F.try_variant_get("_v", f"$.{name}", of.simpleString())
        if name in defaults:
            read = F.when(F.array_contains(names, name), read).otherwise(F.lit(defaults[name]))
        return F.when(F.col("error").isNull(), read).alias(name)

    return out.select(*rows.columns, *(column(f.name, f.dataType) for f in kinds), "error")
