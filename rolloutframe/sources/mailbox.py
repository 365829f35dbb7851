"""Socket transport of batches: a mailbox, and the stream source and sink that talk to it.

A mailbox is a small TCP server that keeps batches between their senders and their receiver. Senders stage the parts of a
batch from their tasks and publish the batch from the driver, so a batch arrives whole or not at all; one that a sender
publishes again, after a restart, is passed over. The receiver's offsets are the numbers of parts by sender, a part may be
read again until the receiver has committed past it, and is then dropped. Parts are Arrow streams.

``spark.readStream.format("mailbox")`` reads a topic, one task for at most TASK_PARTS new parts of a sender; ``writeStream`` to it
stages in tasks and publishes in the commit of a micro-batch. With a ``rank`` column a sink deals rows to a topic for each
rank. While published parts wait to be fetched, senders wait as soon as ``capacity`` bytes would be held. A batch is published
whole, so one that is larger than that is still taken: parts beyond ``capacity`` bytes of memory lie in files of the
mailbox's host. What has been fetched stays until it is committed, which Spark does when a receiver's next micro-batch
begins. Nothing outlives the process: when it ends, senders must publish again what receivers have not committed.
"""

from __future__ import annotations

import io
import json
import socket
import socketserver
import struct
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import suppress
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..extensions import Receiver, Sender
from .shared import written

BATCHES = "batches"
CAPACITY = 256 << 20
STALE = 600  # seconds without a word of its sender after which a staged part that was never published goes
TASK_PARTS = 64  # parts that one task reads
PATIENCE = 120  # seconds that a sender waits for room


def rank_topic(rank) -> str:
    return f"rank_{rank}"


def _send(sock: socket.socket, head: dict, body: bytes = b"") -> None:
    text = json.dumps(head).encode()
    sock.sendall(struct.pack(">IQ", len(text), len(body)) + text + body)


def _receive(sock: socket.socket) -> tuple[dict, bytes] | None:
    def exactly(n: int) -> bytes | None:
        out = bytearray()
        while len(out) < n:
            got = sock.recv(min(1 << 20, n - len(out)))
            if not got:
                return None
            out += got
        return bytes(out)

    sizes = exactly(12)
    if sizes is None:
        return None
    text, body = (exactly(n) for n in struct.unpack(">IQ", sizes))
    return None if text is None or body is None else (json.loads(text), body)


class Mailbox:
    """The server. ``with Mailbox() as box``: listens on box.address until the block ends."""

    def __init__(self, host: str = "127.0.0.1", port: int = 0, capacity: int = CAPACITY, stale: float = STALE):
        self.capacity, self.stale, self.held = capacity, stale, 0  # held: bytes that have not been fetched
        self.waiting, self.memory = 0, 0  # bytes of held that are published; bytes of all parts that are not in files
        self.files = tempfile.TemporaryDirectory(prefix="mailbox-")
        self.fetched: set[tuple[str, str, int]] = set()
        self.heard: dict[str, float] = {}  # sender: when it last staged
        self.staged: dict[str, tuple[str, str, int, bytes | Path]] = {}  # token: topic, sender, size, part
        self.parts: dict[str, dict[str, dict[int, tuple[int, bytes | Path]]]] = {}  # topic: sender: number: size, part
        self.ends: dict[str, dict[str, int]] = {}
        self.published: dict[str, int] = {}  # sender: its last batch
        self.lock = threading.Lock()
        box = self

        class Handler(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                with suppress(ConnectionError):  # a client that goes away has no claim on an answer
                    self.talk()

            def talk(self) -> None:
                while (got := _receive(self.request)) is not None:
                    try:
                        head, body = box.answer(*got)
                    except Exception as e:  # told to the client, which raises it
                        head, body = {"error": f"{type(e).__name__}: {e}"}, b""
                    _send(self.request, head, body)

        class Server(socketserver.ThreadingTCPServer):
            allow_reuse_address, daemon_threads = True, True

        self.server = Server((host, port), Handler)
        self.address = f"{host}:{self.server.server_address[1]}"

    def __enter__(self) -> Mailbox:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.server.shutdown()
        self.server.server_close()
        self.files.cleanup()

    def answer(self, head: dict, body: bytes) -> tuple[dict, bytes]:
        with self.lock:
            return getattr(self, f"_{head.pop('do')}")(body, **head)

    def _kept(self, body: bytes, name: str) -> bytes | Path:
        if self.memory + len(body) <= self.capacity:
            self.memory += len(body)
            return body
        path = Path(self.files.name, name)
        path.write_bytes(body)
        return path

    def _gone(self, size: int, part: bytes | Path) -> None:
        if isinstance(part, Path):
            part.unlink()
        else:
            self.memory -= size

    def _drop(self, _: bytes, tokens: list[str]) -> tuple[dict, bytes]:
        for t in tokens:
            if t in self.staged:
                _, _, size, part = self.staged.pop(t)
                self.held -= size
                self._gone(size, part)
        return {}, b""

    def _stage(self, body: bytes, sender: str, topic: str) -> tuple[dict, bytes]:
        now = time.monotonic()
        self.heard[sender] = now
        self._drop(b"", [t for t, (_, own, _, _) in self.staged.items() if now - self.heard[own] > self.stale])
        # only what is published can be fetched: to wait for a batch's own parts would never end
        if self.waiting and self.held + len(body) > self.capacity:
            return {"full": True}, b""
        token = uuid.uuid4().hex
        self.staged[token] = (topic, sender, len(body), self._kept(body, token))
        self.held += len(body)
        return {"token": token}, b""

    def _publish(self, _: bytes, sender: str, batch: int, tokens: list[str]) -> tuple[dict, bytes]:
        if batch <= self.published.get(sender, -1):
            return {"again": True}, self._drop(b"", tokens)[1]
        if lost := [t for t in tokens if t not in self.staged]:
            raise LookupError(f"{len(lost)} parts of batch {batch} of {sender} are not here")
        for t in tokens:
            topic, own, size, part = self.staged.pop(t)
            number = self.ends.setdefault(topic, {}).get(own, 0)
            self.parts.setdefault(topic, {}).setdefault(own, {})[number] = (size, part)
            self.ends[topic][own] = number + 1
            self.waiting += size
        self.published[sender] = batch
        return {}, b""

    def _offsets(self, _: bytes, topic: str) -> tuple[dict, bytes]:
        return {"ends": self.ends.get(topic, {})}, b""

    def _fetch(self, _: bytes, topic: str, sender: str, number: int) -> tuple[dict, bytes]:
        got = self.parts.get(topic, {}).get(sender, {}).get(number)
        if got is None:
            raise LookupError(f"part {number} of {sender} on {topic} is not here")
        size, part = got
        if (topic, sender, number) not in self.fetched:
            self.fetched.add((topic, sender, number))
            self.held -= size
            self.waiting -= size
        return {}, part.read_bytes() if isinstance(part, Path) else part

    def _release(self, _: bytes, topic: str, ends: dict[str, int]) -> tuple[dict, bytes]:
        for sender, end in ends.items():
            own = self.parts.get(topic, {}).get(sender, {})
            for number in [n for n in own if n < end]:
                size, part = own.pop(number)
                self._gone(size, part)
                if (topic, sender, number) in self.fetched:
                    self.fetched.remove((topic, sender, number))
                else:
                    self.held -= size
                    self.waiting -= size
        return {}, b""

    def _last(self, _: bytes, sender: str) -> tuple[dict, bytes]:
        return {"batch": self.published.get(sender, -1)}, b""


class Client:
    """One connection to a mailbox."""

    def __init__(self, address: str):
        host, _, port = address.rpartition(":")
        self.sock = socket.create_connection((host, int(port)), timeout=PATIENCE)

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_) -> None:
        self.sock.close()

    def ask(self, do: str, body: bytes = b"", **head) -> tuple[dict, bytes]:
        _send(self.sock, {"do": do, **head}, body)
        got = _receive(self.sock)
        if got is None:
            raise ConnectionError("the mailbox has gone")
        if "error" in got[0]:
            raise RuntimeError(got[0]["error"])
        return got

    def stage(self, sender: str, topic: str, part: bytes) -> str:
        until = time.monotonic() + PATIENCE
        while "token" not in (got := self.ask("stage", part, sender=sender, topic=topic)[0]):
            if time.monotonic() > until:
                raise TimeoutError("the mailbox stays full")
            time.sleep(0.05)
        return got["token"]


def packed(batches: list[pa.RecordBatch]) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batches[0].schema) as w:
        for b in batches:
            w.write_batch(b)
    return out.getvalue()


def unpacked(part: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(part)


def staged(batches: Iterator[pa.RecordBatch], address: str, sender: str, rank: str | None) -> list[str]:
    """Tokens of the parts of a task, one for each Arrow batch and topic: a task holds one batch at a time."""
    tokens = []
    with Client(address) as c:
        for b in batches:
            if not b.num_rows:
                continue
            if rank is None:
                tokens.append(c.stage(sender, BATCHES, packed([b])))
                continue
            for value in pc.unique(b.column(rank)).to_pylist():
                own = pc.is_null(b.column(rank)) if value is None else pc.equal(b.column(rank), value)
                tokens.append(c.stage(sender, rank_topic(value), packed([b.filter(own)])))
    return tokens


class Part(InputPartition):
    def __init__(self, sender: str, start: int, end: int):
        super().__init__((sender, start, end))
        self.sender, self.start, self.end = sender, start, end


def _parts(start: dict, end: dict) -> list[Part]:
    return [Part(s, i, min(i + TASK_PARTS, n)) for s, n in sorted(end.items()) for i in range(start.get(s, 0), n, TASK_PARTS)]


def _read(address: str, topic: str, part: Part | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # what a reader without parts is asked for
        return
    with Client(address) as c:
        for number in range(part.start, part.end):
            yield from unpacked(c.ask("fetch", topic=topic, sender=part.sender, number=number)[1])


class StreamReader(DataSourceStreamReader):
    def __init__(self, address: str, topic: str):
        self.address, self.topic = address, topic

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        with Client(self.address) as c:
            return c.ask("offsets", topic=self.topic)[0]["ends"]

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return _parts(start, end)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _read(self.address, self.topic, partition)

    def commit(self, end: dict) -> None:
        with Client(self.address) as c:
            c.ask("release", topic=self.topic, ends=end)


class BatchReader(DataSourceReader):
    """All that is in the mailbox and not yet released."""

    def __init__(self, address: str, topic: str, start: dict, end: dict):
        self.address, self.topic, self.start, self.end = address, topic, start, end

    def partitions(self) -> list[Part]:
        return _parts(self.start, self.end)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _read(self.address, self.topic, partition)


class Staged(WriterCommitMessage):
    def __init__(self, tokens: list[str]):
        self.tokens = tokens


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, address: str, sender: str, rank: str | None):
        self.address, self.sender, self.rank = address, sender, rank

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return Staged(staged(iterator, self.address, self.sender, self.rank))

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        with Client(self.address) as c:
            c.ask("publish", sender=self.sender, batch=batchId, tokens=[t for m in messages if m for t in m.tokens])

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        with Client(self.address) as c:
            c.ask("drop", tokens=[t for m in messages if m for t in m.tokens])


class MailboxSource(DataSource):
    """Options: address (host:port), topic (read; default "batches"), sender (write), rank (write; a column). A schema must
    be given to read."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def _topic(self) -> str:
        return self.options.get("topic", BATCHES)

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(self.options["address"], self._topic())

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options["address"], self._topic(), json.loads(self.options["start"]), json.loads(self.options["end"]))

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options["address"], self.options["sender"], self.options.get("rank"))


def read_mailbox(spark: SparkSession, address: str, schema: StructType | str, topic: str = BATCHES) -> DataFrame:
    """A topic as a stream."""
    spark.dataSource.register(MailboxSource)
    return spark.readStream.format("mailbox").schema(schema).option("address", address).option("topic", topic).load()


def write_mailbox(stream: DataFrame, address: str, sender: str, checkpoint: str, rank: str | None = None):
    """A started query that sends what is available of a stream."""
    stream.sparkSession.dataSource.register(MailboxSource)
    w = stream.writeStream.format("mailbox").option("address", address).option("sender", sender).option("checkpointLocation", checkpoint)
    return (w if rank is None else w.option("rank", rank)).trigger(availableNow=True).start()


class SocketSender(Sender):
    """Sends tables to a mailbox, each as one batch. A sender of the same name goes on behind the last batch."""

    def __init__(self, address: str, micro: bool = False, name: str | None = None):
        self.address, self.rank, self.name = address, "worker" if micro else None, name or uuid.uuid4().hex
        with Client(address) as c:
            self.batch = c.ask("last", sender=self.name)[0]["batch"] + 1

    def send(self, rows: DataFrame) -> None:
        address, name, rank = self.address, self.name, self.rank

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pydict({"token": pa.array(staged(batches, address, name, rank), pa.string())})

        tokens = [r.token for r in rows.mapInArrow(run, "token string").collect()]  # one for each Arrow batch
        with Client(address) as c:
            c.ask("publish", sender=name, batch=self.batch, tokens=tokens)
        self.batch += 1


class SocketReceiver(Receiver):
    """What has come since the last call, as a table of the shared folder; it is then released."""

    def __init__(self, spark: SparkSession, address: str, schema: StructType, micro: bool = False, rank: int = 0):
        self.spark, self.address, self.schema = spark, address, schema
        self.topic, self.start = rank_topic(rank) if micro else BATCHES, {}

    def receive(self) -> DataFrame:
        self.spark.dataSource.register(MailboxSource)
        with Client(self.address) as c:
            end = c.ask("offsets", topic=self.topic)[0]["ends"]
            reader = self.spark.read.format("mailbox").schema(self.schema).option("address", self.address).option("topic", self.topic)
            rows = written(reader.option("start", json.dumps(self.start)).option("end", json.dumps(end)).load())
            c.ask("release", topic=self.topic, ends=end)
        self.start = end
        return rows
