"""WAV files of any length as frames: a data source that deals files out by ranges of bytes.

A file is cut into ranges of ``split_bytes``, and small files share a task, so neither a long
file nor a million short ones are one task's. The driver lists names and sizes alone. A task reads a
file's header, a few hundred bytes as a rule, and of the samples only those of the frames that begin in its
range, wherever the cuts lie. Files are opened through Arrow's file systems, so paths may be
local or URIs of a store that those reach.

``spark.dataSource.register(wav.WavFrames)``, then ``spark.read.format("wav_frames").load(folder)``. Options: ``size``, samples
a frame (4096); ``split_bytes`` (32 MB); ``headers``, true for a row for each file without any samples: ``path, rate,
channels, bits, samples``. PCM of 8, 16, 24 and 32 bits and floats of 32 and 64 are read; other files have no
row, and a file that ends early has the samples that are there.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAMES = "path string, rate int, channels int, frame long, left array<float>, right array<float>"
HEADERS = "path string, rate int, channels int, bits int, samples long"
# Fixed values of the file format: the codes of whole numbers, floats, and of a header that has the code further on.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


class Header(NamedTuple):
    rate: int
    channels: int
    bits: int
    code: int
    start: int  # of the samples, in bytes
    samples: int

    @property
    def width(self) -> int:
        return self.channels * self.bits // 8


def header(file, length: int) -> Header | None:
    """What a file says of its samples: its chunks' heads are read one by one, their contents skipped."""
    file.seek(0)
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= length:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            raw = file.read(min(size, 40))
            if len(raw) < 16:
                return None
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            form = (struct.unpack("<H", raw[24:26])[0] if code == EXTENSIBLE and len(raw) >= 26 else code), channels, rate, bits
        elif name == b"data":
            if form is None:
                return None
            code, channels, rate, bits = form
            if not channels or not rate or (code, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
                return None
            return Header(rate, channels, bits, code, at + 8, max(0, min(size, length - at - 8)) // (channels * bits // 8))
        at += 8 + size + size % 2
    return None


def decoded(raw: bytes, h: Header) -> np.ndarray:
    """Samples by channel, whole numbers scaled to -1 to 1."""
    if h.code == FLOAT:
        x = np.frombuffer(raw, f"<f{h.bits // 8}").astype(np.float32)
    elif h.bits == 8:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif h.bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = (wide.view("<i4")[:, 0] / (1 << 31)).astype(np.float32)
    else:
        x = np.frombuffer(raw, f"<i{h.bits // 8}").astype(np.float32) / float(1 << (h.bits - 1))
    return x.reshape(-1, h.channels)


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges  # path, length, and from which byte to which


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size, self.split = int(options.get("size", 4096)), int(options.get("split_bytes", 32 << 20))
        self.headers = options.get("headers", "false").lower() == "true"
        if self.size <= 0 or self.split <= 0:
            raise ValueError("size and split_bytes must be positive")

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        store, base = self.store()
        info = store.get_file_info(base)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        out: list[Ranges] = []
        room = 0
        for f in sorted(files, key=lambda f: f.path):
            if f.type != fs.FileType.File or not f.path.lower().endswith(".wav"):
                continue
            for a in range(0, 1 if self.headers else f.size, self.split):
                part = (f.path, f.size, a, min(a + self.split, f.size))
                cost = min(self.split, 64 << 10) if self.headers else part[3] - part[2]
                if cost > room:
                    out.append(Ranges([]))
                    room = self.split
                out[-1].ranges.append(part)
                room -= cost
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = self.store() if partition.ranges else (None, None)
        for path, length, a, b in partition.ranges:
            with store.open_input_file(path) as file:
                h = header(file, length)
                if h is None:
                    continue
                if self.headers:
                    yield pa.RecordBatch.from_pylist([dict(path=path, rate=h.rate, channels=h.channels, bits=h.bits, samples=h.samples)], pa.schema([("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("samples", pa.int64())]))
                else:
                    yield from self.frames(file, path, h, a, b)

    def frames(self, file, path: str, h: Header, a: int, b: int) -> Iterator[pa.RecordBatch]:
        step = self.size * h.width
        first, end = (max(0, -(-(x - h.start) // step)) for x in (a, b))  # frames that begin in the range
        end = min(end, -(-h.samples // self.size))
        for frame in range(first, end, 256):  # a bounded number at once
            stop = min(frame + 256, end)
            file.seek(h.start + frame * step)
            count = min(stop * self.size, h.samples) - frame * self.size
            x = decoded(file.read(count * h.width), h)
            cuts = pa.array([*range(0, len(x), self.size), len(x)], pa.int32())
            left, right = (pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(x[:, c]))) for c in (0, -1))
            n = stop - frame
            columns = [pa.array([path] * n), pa.array([h.rate] * n, pa.int32()), pa.array([h.channels] * n, pa.int32()), pa.array(range(frame, stop), pa.int64()), left, right]
            yield pa.RecordBatch.from_arrays(columns, ["path", "rate", "channels", "frame", "left", "right"])


class WavFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return HEADERS if self.options.get("headers", "false").lower() == "true" else FRAMES

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
