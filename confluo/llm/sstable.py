"""Documents as sorted-string-table shards.

A shard is what a file of this layout holds, cut into rows of a DataFrame in file order:

* data blocks: entries in key order, each ``varint shared, varint unshared, varint size, key tail, value``,
  where ``shared`` bytes of the key are those of the entry before (0 at every restart); then the restart
  offsets and their number as little-endian u32; all of it compressed with Zstandard;
* one filter block: a Bloom filter over the keys of the shard;
* one index block: for each data block its last key, offset, size and checksum;
* a footer of fixed size that says where index and filter are.

A key is an 8-byte big-endian number that sorts as the signed id does; the empty key stands for a null id and
sorts first. A lookup asks the filter, searches the sparse index by bisection, reads one block (more
only if a key goes on in the next) and bisects its restarts.

Text is stored as token ids (u16, or u32 for larger vocabularies) or, without a tokenizer, as UTF-8.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import flat, tokens

MAGIC = 0x53535443464C4F31
FOOTER = struct.Struct("<QQQQQQQ")  # index offset and size, filter offset and size, entries, blocks, magic
BLOCK_BYTES = 64 << 10
RESTART = 16
BITS_PER_KEY = 10
PROBES = 7
SHARD_DOCS = 20_000
SCHEMA = "shard bigint, part int, kind string, first_id bigint, last_id bigint, n_entries bigint, byte_offset bigint, payload binary"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probe_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    h = flat.mix(ids.astype(np.uint64, copy=False), 5)
    step = flat.mix(h, 6) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def bloom(ids: np.ndarray) -> bytes:
    """Bits of a Bloom filter for signed 64-bit ids."""
    bits = max(64, -(-len(ids) * BITS_PER_KEY // 8) * 8)
    have = np.zeros(bits, np.uint8)
    have[_probe_bits(ids.view(np.uint64), bits).ravel().astype(np.int64)] = 1
    return np.packbits(have, bitorder="little").tobytes()


def in_bloom(bits: bytes, doc_id: int) -> bool:
    at = _probe_bits(np.array([doc_id], np.int64).view(np.uint64), len(bits) * 8)[0].astype(np.int64)
    return bool((np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7) & 1).all())


class ShardWriter:
    """Takes entries in key order; ``parts`` gives rows of the shard as they become full."""

    def __init__(self, shard: int, block_bytes: int = BLOCK_BYTES):
        self.shard, self.block_bytes, self.offset, self.part = shard, block_bytes, 0, 0
        self.ids: list[int] = []
        self.index: list[bytes] = []
        self.entries = 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self._fresh()

    def _fresh(self) -> None:
        self.raw, self.restarts, self.n, self.last, self.first = bytearray(), [], 0, b"", b""

    def _row(self, kind: str, first: int | None, last: int | None, n: int, payload: bytes) -> tuple:
        row = (self.shard, self.part, kind, first, last, n, self.offset, payload)
        self.part += 1
        self.offset += len(payload)
        return row

    def add(self, doc_id: int | None, value: bytes) -> tuple | None:
        key, shared = key_of(doc_id), 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.raw))
        elif key == self.last:
            shared = len(key)
        elif key and self.last:
            x = int.from_bytes(key, "big") ^ int.from_bytes(self.last, "big")
            shared = 8 - (x.bit_length() + 7) // 8
        if not self.n:
            self.first = key
        self.raw += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.n += 1
        self.last = key
        if doc_id is not None:
            self.ids.append(doc_id)
        return self._flush() if len(self.raw) >= self.block_bytes else None

    def _flush(self) -> tuple | None:
        if not self.n:
            return None
        raw = bytes(self.raw) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        data = self.zip.compress(raw)
        self.index.append(struct.pack("<B8sQQI", len(self.last), self.last, self.offset, len(data), zlib.crc32(data)))
        row = self._row("data", id_of(self.first), id_of(self.last), self.n, data)
        self.entries += self.n
        self._fresh()
        return row

    def close(self) -> list[tuple]:
        rows = [r for r in [self._flush()] if r]
        blocks = len(self.index)
        ids = np.array(self.ids, np.int64)
        lo, hi = (int(ids[0]), int(ids[-1])) if len(ids) else (None, None)
        at_filter, bits = self.offset, bloom(ids)
        rows.append(self._row("filter", lo, hi, self.entries, bits))
        at_index, index = self.offset, b"".join(self.index)
        rows.append(self._row("index", lo, hi, self.entries, index))
        rows.append(self._row("footer", lo, hi, self.entries, FOOTER.pack(at_index, len(index), at_filter, len(bits), self.entries, blocks, MAGIC)))
        return rows


class ShardReader:
    """Lookups in a shard: its bytes, or an open file that can seek. Of a file the footer, filter and index are read, and then the blocks asked for."""

    def __init__(self, data: bytes | BinaryIO):
        self.file = io.BytesIO(data) if isinstance(data, bytes) else data
        size = self.file.seek(0, io.SEEK_END)
        if size < FOOTER.size:
            raise ValueError("too short for a shard")
        at, size_, filter_at, filter_size, self.entries, self.blocks, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index, self.filter = self._read(at, size_), self._read(filter_at, filter_size)
        entry = struct.Struct("<B8sQQI")
        self.index = [(key[:n], offset, length, crc) for n, key, offset, length, crc in entry.iter_unpack(index)]
        self.last_keys = [x[0] for x in self.index]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, k: int) -> tuple[bytes, list[int], int]:
        _, offset, length, crc = self.index[k]
        data = self._read(offset, length)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {k} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(data)
        (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 * (n + 1)
        return raw, list(struct.unpack_from(f"<{n}I", raw, end)), end

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            tail, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + tail]
            yield key, raw[at + tail : at + tail + size]
            at += tail + size

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of this id, in the order of the shard; none if it isn't there."""
        if doc_id is not None and not in_bloom(self.filter, doc_id):
            return []
        key, out = key_of(doc_id), []
        for k in range(bisect_left(self.last_keys, key), len(self.index)):
            raw, restarts, end = self._block(k)
            # The key may start after the last restart that is less than it, or at the first.
            lo = max(bisect_left(restarts, key, key=lambda at: next(self._entries(raw, at, end))[0]) - 1, 0)
            for have, value in self._entries(raw, restarts[lo], end):
                if have == key:
                    out.append(value)
                elif have > key:
                    return out
        return out

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.index)):
            raw, _, end = self._block(k)
            for key, value in self._entries(raw, 0, end):
                yield id_of(key), value


def _tokenizer(path: str) -> tokens.Encoder:
    return tokens.encoder(tokens.read_tokenizer(path))


def encode_value(text: bytes | None, rest: bytes) -> bytes:
    """A document's value: its text (or its token ids), by a length that tells null from empty, then its other columns as JSON."""
    return (_varint(0) if text is None else _varint(len(text) + 1) + text) + rest


def decode_value(value: bytes, token_path: str | None = None) -> tuple[str | np.ndarray | None, str]:
    """The text, or its token ids, and the other columns' JSON."""
    n, at = _read_varint(value, 0)
    text, rest = value[at : at + max(n - 1, 0)], value[at + max(n - 1, 0) :].decode()
    if n == 0:
        return None, rest
    if token_path:
        return np.frombuffer(text, _tokenizer(token_path).dtype), rest
    return text.decode(), rest


def build_shards(docs: DataFrame, *, shard_docs: int = SHARD_DOCS, block_bytes: int = BLOCK_BYTES, tokenizer: str | None = None) -> DataFrame:
    """Rows of shards, in the order of ``shard`` and ``part``; the payloads of a shard in order are its file.

    Documents are split into ranges of ``doc_id`` of about ``shard_docs`` rows each and sorted in them, so a shard
    is found by its first and last id. Every row is stored. Rows of one id are stored side by side, in the order
    of their content. A null id is stored under the empty key, null and empty texts as such. All other
    columns, whatever their names, are stored with the text as a JSON object. An empty table gives no rows. Texts of any
    length are stored whole. ``tokenizer`` is the path of a tokenizer file that the driver can read; its content is broadcast.
    """
    shards = -(-docs.select("doc_id").count() // shard_docs) or 1
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("{}")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))

    sent = tokens.send(docs.sparkSession, tokenizer) if tokenizer else None

    def stored(texts: pa.Array) -> list[bytes | None]:
        """What stands for each text of a batch."""
        if sent is None:
            return texts.cast(pa.large_binary()).to_pylist()
        ids, at = tokens.encoder(sent.value).encode(texts)
        raw, at = ids.tobytes(), (at * ids.itemsize).tolist()
        return [raw[a:b] if there else None for a, b, there in zip(at, at[1:], texts.is_valid().to_pylist())]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_entries", pa.int64()), ("byte_offset", pa.int64()), ("payload", pa.binary())])
        writer = ShardWriter(TaskContext.get().partitionId(), block_bytes)
        done, held = [], 0

        def batch_of(parts: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts), schema)], schema=schema)

        some = False
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for doc_id, text, extra in zip(ids, stored(batch.column("text")), batch.column("rest").cast(pa.large_binary()).to_pylist()):
                some = True
                part = writer.add(doc_id, encode_value(text, extra))
                if part:
                    done.append(part)
                    held += len(part[-1])
            if held > 8 << 20:
                yield batch_of(done)
                done, held = [], 0
        if some:
            yield batch_of(done + writer.close())

    return rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text", "rest").mapInArrow(write, SCHEMA)


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (a path, or a URI such as hdfs://, s3:// or file://) and the path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def save_shards(parts: DataFrame, folder: str) -> None:
    """Write each shard to ``folder``, which all executors share (a path or a URI), as ``shard-NNNNN.sst``.

    A task writes under a name of its own and moves the file when it is whole, so a task that runs again replaces
    its file by the same one. ``parts`` comes from :func:`build_shards`, each shard in one partition.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _open_folder(folder)
        system.create_dir(root, recursive=True)
        out, shard, name = None, None, ""

        def close() -> None:
            out.close()
            system.move(name, f"{root}/shard-{shard:05d}.sst")

        for batch in batches:
            for s, payload in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                if s != shard:
                    if out:
                        close()
                    shard, name = s, f"{root}/.shard-{s:05d}.{TaskContext.get().taskAttemptId()}"
                    out = system.open_output_stream(name)
                out.write(payload.as_py())
        if out:
            close()
        yield from ()

    parts.select("shard", "payload").mapInArrow(save, "done int").count()


def read_shards(folder: str) -> list[ShardReader]:
    """Readers of the shards of a folder, in order. Blocks are read when they are asked for."""
    system, root = _open_folder(folder)
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".sst"))
    return [ShardReader(system.open_input_file(n)) for n in names]
