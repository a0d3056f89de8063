"""Strict JSON: what Spark's readers forgive is an error here.

Records are parsed in Python workers: duplicate keys, NaN, infinities,
overlong nesting, bad UTF-8 and unknown or wrongly typed fields are refused.
Small files, and large ones that are an array or a single object, are read
whole (`binaryFile`). A large file with an object on its first line is JSON
Lines and is read in splits, so neither its size nor the number of files
bounds what a task holds.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arbiter.errors import DataValidationError
from arbiter.functions.text import blank
from arbiter.storage import materialise

DEPTH = 200
REQUIRED = object()

#: Bytes of a file that is read whole whatever its shape, of a first line that is looked at, and rows that go to the JVM at once. Fixed values.
SMALL_FILE, FIRST_LINE, BATCH = 1 << 20, 1 << 24, 4096

#: kind of a field: (accepted Python types, what it is called)
KINDS: dict[str, tuple[tuple[type, ...], str]] = {
    "string": ((str,), "a string"), "int": ((int,), "an integer"), "number": ((int, float), "a number"), "bool": ((bool,), "true or false"),
    "strings": ((list,), "a list of strings"), "object": ((dict,), "an object"), "list": ((list,), "a list"), "any": ((object,), "a value"),
}


def _pairs(items: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(items)
    if len(found) != len(items):
        raise DataValidationError("an object repeats a key")
    return found


def _constant(name: str) -> float:
    raise DataValidationError(f"{name} is no JSON number")


def _float(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise DataValidationError(f"{text} is out of range")
    return value


_DECODER = json.JSONDecoder(object_pairs_hook=_pairs, parse_constant=_constant, parse_float=_float)


def _depth(text: str) -> None:
    if len(text) <= DEPTH or text.count("[") + text.count("{") <= DEPTH:
        return
    level = most = 0
    quoted = escaped = False
    for c in text:
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "[{":
            level += 1
            most = max(most, level)
        elif c in "]}":
            level -= 1
    if most > DEPTH:
        raise DataValidationError(f"nesting is deeper than {DEPTH}")


def loads(text: str) -> Any:
    """One JSON value, strictly."""
    _depth(text)
    try:
        return _DECODER.decode(text)
    except json.JSONDecodeError as error:
        raise DataValidationError(f"not JSON: {error}") from error


def decode(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError as error:
        raise DataValidationError("not UTF-8") from error


def records(text: str, blank_lines: bool = True) -> Iterator[dict[str, Any]]:
    """Objects of an array, of a single object, or of lines with one object each."""
    head = text.lstrip()[:1]
    if not head:
        return
    if head == "[":
        rows = loads(text)
    else:
        try:
            rows = [loads(text)]
        except DataValidationError:
            lines = text.split("\n")
            if lines and not lines[-1]:
                lines.pop()
            if not blank_lines and not all(x.strip() for x in lines):
                raise DataValidationError("a line is blank") from None
            rows = [loads(x) for x in lines if x.strip()]
    for r in rows:
        yield _object(r)


def _is(value: Any, kind: str) -> bool:
    types, _ = KINDS[kind]
    if isinstance(value, bool) and kind not in ("bool", "any"):
        return False
    return isinstance(value, types) and (kind != "strings" or all(isinstance(x, str) for x in value))


def read_fields(record: dict[str, Any], rules: dict[str, tuple[str, Any]], what: str) -> dict[str, Any]:
    """A record's fields by rules name -> (kind, default or REQUIRED). A default of None lets null stand."""
    if unknown := set(record) - set(rules):
        raise DataValidationError(f"{what} has unknown fields: {sorted(unknown)}")
    out = {}
    for name, (kind, default) in rules.items():
        value = record.get(name, default)
        if value is REQUIRED:
            raise DataValidationError(f"{what} lacks {name}")
        if not (value is None and default is None) and not _is(value, kind):
            raise DataValidationError(f"{what}: {name} must be {KINDS[kind][1]}")
        out[name] = value
    return out


def translate(error: PySparkException) -> DataValidationError | None:
    """The worker's own message of a validation error."""
    text = str(error)
    mark = "DataValidationError: "
    return DataValidationError(text[text.index(mark) + len(mark) :].split("\n")[0]) if mark in text else None


def _first_line(spark: SparkSession, path: str) -> bytes:
    """A file's first line that isn't blank, or as much of it as is looked at."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        held = b""
        while len(held) < FIRST_LINE and (more := bytes(stream.readNBytes(1 << 16))):
            held = (held + more).removeprefix(b"\xef\xbb\xbf").lstrip()
            if b"\n" in held:
                break
    finally:
        stream.close()
    return held.split(b"\n")[0]


def _places(lines: DataFrame, max_records: int | None, blank_lines: bool) -> dict[int, int]:
    """The records of a file before each of its splits: one row a split."""
    empty = blank(F.col("value").cast("string"))
    total: dict[str, int] = {}
    gaps, out = set(), {}
    for r in lines.groupBy("file", "start", "split").agg(F.count_if(~empty).alias("n"), F.count_if(empty).alias("empty")).orderBy("file", "start").collect():
        if r.split in out:
            raise DataValidationError("two splits have one hash")
        out[r.split] = total.get(r.file, 0)
        total[r.file] = out[r.split] + r.n
        gaps.update([r.file] * (r.empty > 0))
    if max_records is not None and max(total.values()) > max_records:
        raise DataValidationError(f"more than {max_records} records")
    if not blank_lines and any(total[file] > 1 for file in gaps):
        raise DataValidationError("a line is blank")
    return out


def _line(value: bytes) -> str:
    """A line's text; the reader has taken a mark of the byte order away already."""
    try:
        text = value.decode()
    except UnicodeDecodeError as error:
        raise DataValidationError("not UTF-8") from error
    return text if text.strip() else ""


def _object(value: Any) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise DataValidationError("every record must be an object")
    return value


def _is_lines(spark: SparkSession, path: str) -> bool:
    """Whether a file has a whole object on its first line: then it is no other JSON than lines."""
    if set(path) & set("*?[]{}\\"):
        return False  # a path that Spark would take for a pattern
    try:
        return isinstance(json.loads(_first_line(spark, path)), dict)
    except ValueError:
        return False


def _batches(rows: Iterator[dict[str, Any]], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a bounded number of rows."""
    names = {f.name for f in schema.fields if isinstance(f.dataType, T.MapType)}
    arrow = to_arrow_schema(schema)
    while held := list(islice(rows, BATCH)):
        for name in names:
            held = [{**r, name: None if r[name] is None else list(r[name].items())} for r in held]
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def read_records(spark: SparkSession, path: str, convert: Callable[[dict[str, Any]], dict[str, Any]], schema: T.StructType, max_records: int | None = None, blank_lines: bool = True) -> DataFrame:
    """Typed rows of all records below `path`, with their place in the file as `position`.

    `convert` runs in the workers and raises on a record that breaks a rule.
    """
    full = T.StructType([*schema.fields, T.StructField("position", T.LongType())])
    files = spark.read.format("binaryFile").load(path)
    large = [r.path for r in files.filter(F.col("length") > SMALL_FILE).select("path").collect()]
    split = [x for x in large if _is_lines(spark, x)]

    def whole(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for content in f.column("content"):
                yield from _batches(rows(content.as_py()), full)

    def rows(content: bytes) -> Iterator[dict[str, Any]]:
        for k, r in enumerate(records(decode(content), blank_lines)):
            if max_records is not None and k >= max_records:
                raise DataValidationError(f"more than {max_records} records")
            yield {**convert(r), "position": k}

    found = files.filter(~F.col("path").isin(split)) if split else files
    found = found.select("content").mapInArrow(whole, full)
    if not split:
        return found
    lines = spark.read.text(split, lineSep="\n").select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.withColumn("split", F.xxhash64("file", "start"))
    before = _places(lines, max_records, blank_lines)

    def parts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(numbered(frames), full)

    def numbered(frames: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        here, k = None, 0
        for f in frames:
            for value, at in zip(f.column("value").to_pylist(), f.column("split").to_pylist()):
                if at != here:
                    here, k = at, before[at]
                if text := _line(value):
                    yield {**convert(_object(loads(text))), "position": k}
                    k += 1

    parsed = lines.select("value", "split").mapInArrow(parts, full)
    return parsed if len(split) == files.select("path").count() else parsed.union(found)


def checked(df: DataFrame) -> DataFrame:
    """Run a reader once and keep its rows, so its errors surface here as validation errors and no check parses again."""
    try:
        return materialise(df, "records")
    except PySparkException as error:
        raise translate(error) or error from None


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below `path`."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
