"""Length-framed JSON: a codec, a reader of framed files, and network stream sources."""

from __future__ import annotations

import json
import socket
import struct
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.config import DEFAULTS
from ..functions.scalars import framed

LIMIT = DEFAULTS.max_frame_bytes


def frame(payload: bytes) -> bytes:
    return struct.pack(">I", len(payload)) + payload


def unframe(data: bytes, limit: int = LIMIT) -> Iterator[bytes]:
    """The payloads of a run of frames. One over the limit is skipped with its body; a cut-off last one is left out."""
    at = 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        if at + 4 + size > len(data):
            return
        if size <= limit:
            yield data[at + 4 : at + 4 + size]
        at += 4 + size


def whole_frames(data: bytes) -> int:
    """Bytes up to the end of the last whole frame."""
    end = 0
    while end + 4 <= len(data):
        after = end + 4 + struct.unpack_from(">I", data, end)[0]
        if after > len(data):
            break
        end = after
    return end


def frame_column(df: DataFrame, payload: str = "raw") -> DataFrame:
    """Adds frame, the binary frame of each row's payload."""
    return df.withColumn("frame", framed(F.col(payload).cast("binary")))


def read_frames(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """(path, place, raw) of framed files; a file is one unit of work."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = [p.decode("utf-8", "replace") for p in unframe(content.as_py(), limit)]
                yield pa.RecordBatch.from_pydict({"path": [name] * len(found), "place": pa.array(range(len(found)), pa.int64()), "raw": pa.array(found, pa.string())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(split, "path string, place long, raw string")


class FrameFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FrameFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.limit = int(options.get("limit", LIMIT))

    def partitions(self) -> list[InputPartition]:
        return [FrameFile(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for place, payload in enumerate(unframe(f.read(), self.limit)):
                yield place, payload.decode("utf-8", "replace")


class Backoff:
    """Delays between attempts: doubled each time, up to a most; begun anew after a success."""

    def __init__(self, first: float = DEFAULTS.backoff_first_s, most: float = DEFAULTS.backoff_most_s):
        self.first, self.most, self.next = first, most, first

    def failed(self) -> float:
        delay, self.next = self.next, min(self.next * 2, self.most)
        return delay

    def succeeded(self) -> None:
        self.next = self.first


class FrameSocketReader(SimpleDataSourceStreamReader):
    """Reads frames from a TCP peer (options host, port), reconnecting with a backoff; offsets count events read.

    Events are numbered in order of receipt, which is their total order.
    What was read is kept until committed, so that a failed batch is repeated.
    A frame that announces more than `limit` bytes ends its connection.
    """

    def __init__(self, options: dict):
        self.address = (options.get("host", "localhost"), int(options.get("port", "9001")))
        self.most, self.wait_s = int(options.get("rows", "10000")), float(options.get("wait", "1"))
        self.backoff, self.peer, self.rest, self.held = Backoff(), None, b"", {}
        self.limit = int(options.get("limit", LIMIT))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _receive(self) -> list[bytes]:
        if self.peer is None:
            try:
                self.peer = socket.create_connection(self.address, timeout=self.wait_s)
                self.backoff.succeeded()
            except OSError:
                time.sleep(min(self.backoff.failed(), self.wait_s))
                return []
        self.peer.settimeout(self.wait_s)
        found: list[bytes] = []
        try:
            while len(found) < self.most:
                data = self.peer.recv(1 << 16)
                if not data:
                    # what a closed connection left unfinished belongs to no frame of the next
                    self.peer, self.rest = None, b""
                    break
                self.rest += data
                found.extend(unframe(self.rest, self.limit))
                self.rest = self.rest[whole_frames(self.rest) :]
                if len(self.rest) >= 4 and struct.unpack_from(">I", self.rest)[0] > self.limit:
                    # the rest of such a frame is not waited for, so the buffer stays bounded
                    self.peer.close()
                    self.peer, self.rest = None, b""
                    break
        except OSError:
            pass
        return found

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        first = start["n"]
        after = max([first - 1, *self.held]) + 1
        for n, payload in enumerate(self._receive(), after):
            self.held[n] = payload.decode("utf-8", "replace") if isinstance(payload, bytes) else payload
        rows = [(n, raw) for n, raw in sorted(self.held.items()) if n >= first]
        return iter(rows), {"n": first + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(n, raw) for n, raw in sorted(self.held.items()) if start["n"] <= n < end["n"]])

    def commit(self, end: dict) -> None:
        self.held = {n: raw for n, raw in self.held.items() if n >= end["n"]}


class FrameSource(DataSource):
    """Format "frames": batch over framed files (option path or paths), stream over a TCP peer (host, port)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "place long, raw string"

    def reader(self, schema) -> DataSourceReader:
        return FrameFileReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FrameSocketReader(self.options)


def subscribe_message(symbols: list[str]) -> str:
    """The JSON that asks a feed for the ticker channel of these symbols."""
    return json.dumps({"type": "subscribe", "product_ids": symbols, "channels": [{"name": "ticker", "product_ids": symbols}]})


class FeedReader(SimpleDataSourceStreamReader):
    """Reads JSON messages of a WebSocket feed (options url, symbols); needs the websockets package."""

    def __init__(self, options: dict):
        self.url, self.symbols = options["url"], [s.strip() for s in options.get("symbols", "").split(",") if s.strip()]
        self.most, self.wait_s, self.backoff, self.feed, self.held = int(options.get("rows", "10000")), 1.0, Backoff(), None, {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _receive(self) -> list[str]:
        from websockets.sync.client import connect

        found: list[str] = []
        try:
            if self.feed is None:
                self.feed = connect(self.url)
                self.feed.send(subscribe_message(self.symbols))
                self.backoff.succeeded()
            while len(found) < self.most:
                found.append(self.feed.recv(timeout=self.wait_s))
        except TimeoutError:
            pass
        except OSError:
            self.feed = None
            time.sleep(self.backoff.failed())
        return found

    read, readBetweenOffsets, commit = FrameSocketReader.read, FrameSocketReader.readBetweenOffsets, FrameSocketReader.commit


class FeedSource(DataSource):
    """Format "feed": a stream of a WebSocket ticker feed."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "place long, raw string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FeedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
    spark.dataSource.register(FeedSource)
