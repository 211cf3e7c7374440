"""Binary shards: the messages of a profiler's files, decoded to nested rows and encoded from them.

Spark lists and reads the files, from any store that it can reach, one file a row; a task decodes them one by one. Shards are
small pieces of a trace, so that none grows with it (2 GB at most).
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spanweave.sources.shards import SHARDS

# The fields of the messages by number, with their types. A message in a list may come any number of times,
# one in a dictionary is the value of a map with keys of text, and a tuple names the values of an enumeration.
EVENT = {1: ("thread_id", "int"), 2: ("start_time_us", "int"), 3: ("duration_us", "int"), 4: ("name", "text")}
EVENT_LIST = {1: ("events", [EVENT])}
DEVICE_EVENT = {1: ("name", "text"), 2: ("cuda_event_type", ("UNKNOWN", "KERNEL", "MEMCPY", "MEMSET")), 3: ("start_time_us", "int"), 4: ("duration_us", "int")}
DEVICE_EVENTS = {1: ("device_name", "text"), 2: ("events", [DEVICE_EVENT])}
API_STAT = {1: ("tid", "int"), 2: ("api_name", "text"), 3: ("total_time_us", "int"), 4: ("num_calls", "int")}
API_EVENT = {1: ("tid", "int"), 2: ("api_name", "text"), 3: ("start_time_us", "int"), 4: ("duration_us", "int"), 5: ("active_operation", "text")}
OPERATION_COUNT = {1: ("operation_name", "text"), 2: ("num_overhead_events", "int")}
PHASE_COUNTS = {1: ("phase_overhead_events", {"": OPERATION_COUNT})}
SAMPLE = {1: ("start_time_us", "int"), 2: ("util", "float"), 3: ("total_resident_memory_bytes", "int")}
DEVICE_SAMPLES = {1: ("device_name", "text"), 2: ("samples", [SAMPLE])}
PROGRESS = {1: ("content_code", "int"), 2: ("percent_complete", "float"), 3: ("num_timesteps", "int"), 4: ("total_timesteps", "int")}
MESSAGES = {
    "category_events": {1: ("category_events", {"": EVENT_LIST}), 2: ("process_name", "text"), 3: ("phase", "text"), 4: ("machine_name", "text")},
    "cuda_device_events": {1: ("process_name", "text"), 2: ("phase", "text"), 3: ("machine_name", "text"), 4: ("dev_events", {"": DEVICE_EVENTS})},
    "cuda_api_stats": {1: ("process_name", "text"), 2: ("machine_name", "text"), 3: ("phase", "text"), 4: ("stats", [API_STAT]), 5: ("events", [API_EVENT])},
    "op_stack": {1: ("process_name", "text"), 2: ("phase", "text"), 3: ("machine_name", "text"), 4: ("overhead_events", {"": PHASE_COUNTS})},
    "machine_util": {1: ("machine_name", "text"), 2: ("device_util", {"": DEVICE_SAMPLES})},
    "training_progress": {
        1: ("content_code", "int"), 2: ("process_name", "text"), 3: ("phase", "text"), 4: ("machine_name", "text"), 5: ("total_timesteps", "int"), 6: ("start_trace_time_us", "int"),
        7: ("start_percent_complete", "float"), 8: ("start_num_timesteps", "int"), 9: ("start_training_time_us", "int"), 10: ("end_percent_complete", "float"), 11: ("end_training_time_us", "int"), 12: ("end_num_timesteps", "int"),
    },
    "process": {1: ("process_name", "text"), 2: ("phase", "text"), 3: ("machine_name", "text"), 4: ("parent_process_name", "text"), 5: ("training_progress", PROGRESS)},
}
VARINT, EIGHT_BYTES, LENGTH, FOUR_BYTES = 0, 1, 2, 5


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("the message ends within a number")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
        if shift > 63:
            raise ValueError("a number is longer than 10 bytes")


def _fields(data: memoryview) -> Iterator[tuple[int, int, int | memoryview]]:
    """Number, wire type and value (a number, or bytes) of each field of a message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == VARINT:
            value, at = _varint(data, at)
            yield number, kind, value
            continue
        if kind == LENGTH:
            size, at = _varint(data, at)
        elif kind in (EIGHT_BYTES, FOUR_BYTES):
            size = 8 if kind == EIGHT_BYTES else 4
        else:
            raise ValueError(f"wire type {kind} of field {number} is not known")
        if at + size > len(data):
            raise ValueError(f"the message ends within field {number}")
        yield number, kind, data[at : at + size]
        at += size


#: The wire type that each type of field has.
_WIRE = {"int": VARINT, "text": LENGTH, "float": FOUR_BYTES}


def _empty(kind: str | tuple | list | dict) -> int | float | str | list | None:
    if isinstance(kind, (list, dict)):
        return [] if isinstance(kind, list) else None
    return kind[0] if isinstance(kind, tuple) else {"int": 0, "float": 0.0, "text": ""}[kind]


def decode(data: bytes | memoryview, message: dict, wanted: dict | None = None) -> dict:
    """A message as a dictionary, its maps as lists of pairs (of one key the last counts). Fields that are not known are skipped; absent ones have their type's empty value.

    ``wanted`` names the fields to decode (all, if None), and those of messages in them. A message that ends early is an error.
    """
    asked = [(name, kind) for name, kind in message.values() if wanted is None or name in wanted]
    maps = {name for name, kind in asked if isinstance(kind, dict) and "" in kind}
    out = {name: {} if name in maps else _empty(kind) for name, kind in asked}
    for number, wire, value in _fields(memoryview(data)):
        name, kind = message.get(number, (None, None))
        if name not in out:
            continue
        if wire != (_WIRE[kind] if isinstance(kind, str) else VARINT if isinstance(kind, tuple) else LENGTH):
            raise ValueError(f"field {name} has wire type {wire}")
        within = None if wanted is None else wanted[name]
        if kind == "int":
            out[name] = value - (1 << 64) if value >> 63 else value
        elif kind == "float":
            out[name] = struct.unpack("<f", value)[0]
        elif kind == "text":
            out[name] = bytes(value).decode("utf-8", "replace")
        elif isinstance(kind, tuple):
            out[name] = kind[value] if value < len(kind) else kind[0]
        elif isinstance(kind, list):
            out[name].append(decode(value, kind[0], within))
        elif "" in kind:
            entry = {1: b"", 2: b""} | {n: v for n, _, v in _fields(value) if n in (1, 2)}
            out[name][bytes(entry[1]).decode("utf-8", "replace")] = decode(entry[2], kind[""], within)
        else:
            out[name] = decode(value, kind, within)
    return {name: list(v.items()) if name in maps else v for name, v in out.items()}


def _number(n: int) -> bytes:
    out, n = bytearray(), n & 0xFFFFFFFFFFFFFFFF
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _part(number: int, data: bytes) -> bytes:
    return _number(number << 3 | LENGTH) + _number(len(data)) + data


def encode(row: dict, message: dict) -> bytes:
    """A dictionary as a message. Empty and absent values are left out."""
    out = []
    for number, (name, kind) in message.items():
        value = row.get(name)
        if isinstance(kind, tuple):
            value, kind = kind.index(value) if value in kind else 0, "int"
        if not value:
            continue
        if kind == "int":
            out.append(_number(number << 3 | VARINT) + _number(int(value)))
        elif kind == "float":
            out.append(_number(number << 3 | FOUR_BYTES) + struct.pack("<f", value))
        elif kind == "text":
            out.append(_part(number, value.encode()))
        elif isinstance(kind, list):
            out += [_part(number, encode(v, kind[0])) for v in value]
        elif "" in kind:
            out += [_part(number, _part(1, k.encode()) + _part(2, encode(v, kind[""]))) for k, v in (value.items() if isinstance(value, dict) else value)]
        else:
            out.append(_part(number, encode(value, kind)))
    return b"".join(out)


def local_path(folder: str) -> str:
    """A folder's URI, or its path if it is on this machine."""
    return re.sub(r"^file:/+", "/", folder)


def _wanted(kind: pa.DataType) -> dict | None:
    """Names of the fields of a type, with those of the structs in its lists and maps."""
    if pa.types.is_map(kind):
        return _wanted(kind.item_type)
    if pa.types.is_list(kind):
        return _wanted(kind.value_type)
    return {f.name: _wanted(f.type) for f in kind} if pa.types.is_struct(kind) else None


#: Bytes of messages, about, that a task works on as Python's objects, which take some ten times as much.
BATCH_BYTES = 1 << 20


def _messages(data: memoryview) -> Iterator[memoryview]:
    """The messages of a file that holds several, each behind its length."""
    at = 0
    while at < len(data):
        size, at = _varint(data, at)
        if at + size > len(data):
            raise ValueError("the file ends within a message")
        yield data[at : at + size]
        at += size


def _few(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, some of them at a time as Python's objects."""
    n = max(1, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, n):
        yield from batch.slice(at, n).to_pylist()


def read_binary_shards(spark: SparkSession, folder: str, kind: str, names: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """All binary shards of a kind below a folder, one row each, as ``shards.read_shards`` gives them from JSON.

    Files are chosen by the kind's names or by ``names`` (a pattern). Those that end in ``.protos`` hold any number of messages, each behind
    its length (``write_binary_shards``), the others one each. Only ``columns`` are decoded, if given; in the others' place is
    nothing. Fields that a shard has beyond the known ones are skipped; a shard that ends early is an error; an empty file has no row.
    """
    pattern, ddl = SHARDS[kind]
    full = StructType.fromDDL(ddl)
    schema = full if columns is None else StructType([full[c] for c in columns])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names or f"{pattern}.{{proto,protos}}").load(folder)
    arrow, message = to_arrow_schema(schema), MESSAGES[kind]
    wanted = _wanted(pa.struct(list(arrow)))

    def as_batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], type=f.type) for f in arrow], schema=arrow)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                path, data = path.as_py(), memoryview(content.as_buffer()).cast("B")
                try:
                    for message_bytes in _messages(data) if path.endswith(".protos") else [data]:
                        rows.append(decode(message_bytes, message, wanted))
                        size += len(message_bytes)
                        if size > BATCH_BYTES or len(rows) >= 10_000:  # given out at once, so that rows are never kept as Python's objects for long
                            yield as_batch(rows)
                            rows, size = [], 0
                except ValueError as error:
                    raise ValueError(f"{path}: {error}") from error
        if rows:
            yield as_batch(rows)

    return files.select("path", "content").mapInArrow(decoded, schema)


def write_binary_shards(rows: DataFrame, folder: str, kind: str, file_bytes: int | None = None) -> None:
    """A binary shard for each row (of the kind's schema, any of its columns), named as the kind's files are.

    With ``file_bytes`` messages are put together, each behind its length, into files of about that size that end in ``.protos``, so that
    there are not as many files as rows. A task that runs again writes the same files again: rows are numbered in order of their groups.
    """
    message, prefix = MESSAGES[kind], SHARDS[kind][0].rstrip("*")
    group = [c for c in ("machine_name", "process_name", "phase", "part") if c in rows.columns]

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        some, size = [], 0
        for batch in batches:
            for row in _few(batch):
                data = encode(row, message)
                if file_bytes is None:
                    yield [data]
                    continue
                some += [_number(len(data)), data]
                size += len(data)
                if size >= file_bytes:
                    yield some
                    some, size = [], 0
        if some:
            yield some

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pyarrow.fs.FileSystem.from_uri(local_path(folder))
        part, n = TaskContext.get().partitionId(), 0
        for parts in files(batches):
            hidden = f"{base}/.{uuid.uuid4().hex}"
            with system.open_output_stream(hidden, compression=None) as out:
                for data in parts:
                    out.write(data)
            system.move(hidden, f"{base}/{prefix}.{part}.{n}.proto{'' if file_bytes is None else 's'}")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], type=pa.int64())})

    system, base = pyarrow.fs.FileSystem.from_uri(local_path(folder))
    system.create_dir(base, recursive=True)
    rows.sortWithinPartitions(*group).mapInArrow(written, "n long").agg(F.sum("n")).collect()


def texts(shards: DataFrame) -> DataFrame:
    """Shards for people to read: a line of JSON each, in a column ``value`` that Spark's text writer takes."""
    return shards.select(F.to_json(F.struct("*")).alias("value"))
