"""A streaming source of event logs that are still written to, each line exactly once.

The offset of the stream is the number of bytes seen of each log. A log keeps its name in the
offset when the ``.inprogress`` at its end goes, so the rename neither repeats nor loses a
line. Every file of a rolled log counts for itself. The driver only lists names and sizes;
tasks read the bytes between two offsets, a large log in slices.

A line belongs to the slice in which its line feed lies, so that slices may end anywhere, also
within a line that is just being written. What stands behind the last line feed waits for it.
A log that is gone is forgotten; one that became shorter is refused, since lines that were
read may have changed.

A log packed by gzip (``.gz``) may grow too, at its end, by bytes or members. Its offset counts
packed bytes; what it grew by is one slice, for which the bytes before are unpacked again, so
packed logs should be rolled. Other packings are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources.files import opened

FORMAT = "tidemark_live_logs"
RUNNING = ".inprogress"
SLICE_BYTES = 64 << 20
_CHUNK = 4 << 20
GZIP = ".gz"
_PACKED = re.compile(r"\.(zstd|lz4|lzf|snappy)$")
#: Packed bytes that are read at a time.
_PACKED_CHUNK = 256 << 10


class Slice(InputPartition):
    def __init__(self, log: str, start: int, end: int) -> None:
        self.log, self.start, self.end = log, start, end


def sizes(path: str) -> dict[str, int]:
    """Bytes of each log below a folder, by its name without the ending of a running one."""
    system, root = opened(path)
    if system.get_file_info(root).type == pyarrow.fs.FileType.NotFound:
        return {}
    found: dict[str, int] = {}
    for info in system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
        # Status files hold no events, and compacted ones only events of files before them.
        if not info.is_file or re.match(r"[._]|appstatus", info.base_name) or info.base_name.endswith(".compact"):
            continue
        name = info.path.removeprefix(root).strip("/").removesuffix(RUNNING)
        if _PACKED.search(name):
            raise ValueError(f"{name} is compressed; logs to be followed may only be by gzip")
        found[name] = max(found.get(name, 0), info.size)
    return found


def slices(start: dict[str, int], end: dict[str, int], size: int) -> list[Slice]:
    """What to read between two offsets."""
    out = []
    for log, to in sorted(end.items()):
        at = start.get(log, 0)
        if to < at:
            raise ValueError(f"{log} had {at} bytes and now has {to}")
        step = max(1, to - at) if log.endswith(GZIP) else size
        out += [Slice(log, low, min(low + step, to)) for low in range(at, to, step)]
    return out


def _line_start(file: pa.NativeFile, at: int) -> int:
    """Where the line begins that goes on at ``at``."""
    while at > 0:
        low = max(0, at - (64 << 10))
        found = file.read_at(at - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines(file: pa.NativeFile, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines whose line feed lies in [start, end), in lists of bounded size."""
    rest, at = b"", _line_start(file, start)
    while at < end:
        data = file.read_at(min(_CHUNK, end - at), at)
        if not data:
            raise OSError(f"the log ended at byte {at} before {end}")
        at += len(data)
        *whole, rest = (rest + data).split(b"\n")
        if whole:
            yield whole


def _unpacked(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[bool, bytes]]:
    """The text of the first ``end`` packed bytes, and whether it took more than the first ``start``."""
    unpack, at = None, 0
    while at < end:
        data = file.read_at(min(_PACKED_CHUNK, (start if at < start else end) - at), at)
        if not data:
            raise OSError(f"the log ended at byte {at} before {end}")
        new, text = at >= start, b""
        at += len(data)
        # What was held back for its length comes out without further bytes.
        while data or len(text) == _CHUNK:
            if unpack is None:
                # Zeros may stand behind a member.
                data, text = data.lstrip(b"\0"), b""
                if not data:
                    break
                unpack = zlib.decompressobj(31)
            text = unpack.decompress(data, _CHUNK)
            data = unpack.unconsumed_tail
            yield new, text
            if unpack.eof:
                data, unpack = unpack.unused_data, None


def packed_lines(file: pa.NativeFile, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines that the first ``end`` packed bytes hold beyond those of the first ``start``."""
    rest = b""
    for new, text in _unpacked(file, start, end):
        *whole, rest = (rest + text).split(b"\n")
        if new and whole:
            yield whole


def _texts(whole: list[bytes]) -> pa.Array:
    """The lines as strings; only where a byte is no UTF-8 one by one."""
    try:
        return pa.array(whole, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([line.decode("utf-8", "replace") for line in whole], pa.string())


class LiveLogReader(DataSourceStreamReader):
    def __init__(self, path: str, slice_bytes: int) -> None:
        self.path, self.slice_bytes = path, slice_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes(self.path)

    def partitions(self, start: dict, end: dict) -> Sequence[Slice]:
        return slices(start, end, self.slice_bytes)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        file = None
        for ending in ("", RUNNING, ""):  # the log may be renamed meanwhile
            try:
                file = system.open_input_file(f"{root.rstrip('/')}/{partition.log}{ending}")
                break
            except FileNotFoundError:
                continue
        if file is None:
            raise FileNotFoundError(f"{partition.log} is gone before it was read")
        with file:
            read = packed_lines if partition.log.endswith(GZIP) else lines
            for whole in read(file, partition.start, partition.end):
                log = pa.repeat(pa.scalar(partition.log, pa.string()), len(whole))
                yield pa.RecordBatch.from_arrays([log, _texts(whole)], names=["log", "line"])


class LiveLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "log string, line string"

    def streamReader(self, schema) -> LiveLogReader:
        return LiveLogReader(self.options["path"], int(self.options.get("sliceBytes", SLICE_BYTES)))
