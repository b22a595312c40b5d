"""Token ids of whole batches of texts, with a public tokenizer.

A byte-level BPE cuts a text where the last blank of a run stands before something else, and encodes what lies between such places by
itself. So a batch is cut there, its different pieces are encoded once, and the ids of all pieces are gathered with
NumPy. New pieces that begin with a blank are encoded as one text; as ids stand for bytes, the pieces' ends are found again. The
ids are those that the tokenizer gives for whole texts.

A tokenizer file holds byte ranks (a line each: base64 and rank), or is a JSON file of the ``tokenizers`` library, which encodes whole texts.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

from confluo.llm import flat

#: The setting that names the tokenizer file. The driver reads it and broadcasts its content.
TOKENIZER_KEY = "spark.confluo.tokenizer"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_BYTES = 64 << 20
#: Pieces that a worker remembers; it starts anew beyond that.
REMEMBERED = 1 << 19
#: The expression that byte-level BPE cuts texts with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = "<|endoftext|>"

_AFTER = np.ones(256, bool)
_AFTER[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False


def default_tokenizer(spark: SparkSession) -> str:
    """The path that the session's ``spark.confluo.tokenizer`` names, else the default."""
    return spark.conf.get(TOKENIZER_KEY, TOKENIZER)


def read_tokenizer(path: str) -> bytes:
    """The content of a tokenizer file. Only files of up to ``MOST_BYTES`` are taken."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is over {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def send(spark: SparkSession, path: str) -> Broadcast:
    """The content of a tokenizer file, broadcast."""
    return spark.sparkContext.broadcast(read_tokenizer(path))


class Encoder:
    """Ids of texts by the tokenizer in ``data``, the content of a file. ``end`` is the id of the end mark, ``size`` the number of ids with it."""

    def __init__(self, data: bytes):
        self.whole = data[:1] == b"{"
        if self.whole:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(data.decode())
            self.tokenizer.encode_special_tokens = True
            mark = self.tokenizer.token_to_id(END)
            self.end = self.tokenizer.get_vocab_size() if mark is None else mark
            self.size = max(self.tokenizer.get_vocab_size(), self.end + 1)
        else:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            self.end = max(ranks.values()) + 1
            self.size = self.end + 1
            self.tokenizer = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END: self.end})
            self.length = np.zeros(self.size, np.int64)
            self.length[list(ranks.values())] = list(map(len, ranks))
        self.dtype = np.dtype("<u2" if self.size <= 65536 else "<u4")
        self._forget()

    def _forget(self) -> None:
        #: Pieces that are known, their hashes in order and the piece of each hash; piece k has the ids ``ids[first[k] : first[k + 1]]``.
        self.known = pa.array([], pa.large_string())
        self.hashes, self.piece = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.first = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        done = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if self.whole else list(map(self.tokenizer.encode_ordinary, texts))
        sizes = np.fromiter(map(len, done), np.int64, len(done))
        return np.fromiter((x for d in done for x in d), self.dtype, int(sizes.sum())), sizes

    def _as_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with a blank before something else, encoded as one text."""
        ids = np.array(self.tokenizer.encode_ordinary("".join(texts)), np.int64)
        ends = np.cumsum(np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))
        at = np.searchsorted(np.cumsum(self.length[ids]), ends) + 1
        return ids.astype(self.dtype), np.diff(np.concatenate(([0], at)))

    def _numbers(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """The number of each of some different pieces. New ones become known. A hash finds a piece, and its text decides."""
        if len(self.known) > REMEMBERED:
            self._forget()
        raw, off = flat.buffers(pieces)
        h = flat.span_hashes(raw, off[:-1], off[1:])
        number = np.full(len(pieces), -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == h)
            mine = self.piece[at[hit]]
            same = pc.equal(self.known.take(pa.array(mine)), pieces.take(pa.array(hit))).to_numpy(zero_copy_only=False)
            number[hit[same]] = mine[same]
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            texts = pieces.take(pa.array(fresh)).to_pylist()
            as_one = np.array([len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace() for p in texts])
            ids, first, known, n = [self.ids], [self.first], [self.known], len(self.known)
            for some, encode in ((np.flatnonzero(as_one), self._as_one), (np.flatnonzero(~as_one), self._one_by_one)):
                if len(some):
                    number[fresh[some]] = n + np.arange(len(some))
                    n += len(some)
                    new, sizes = encode([texts[k] for k in some])
                    ids.append(new)
                    first.append(first[-1][-1] + np.cumsum(sizes))
                    known.append(pieces.take(pa.array(fresh[some])))
            self.ids, self.first, self.known = np.concatenate(ids), np.concatenate(first), pa.concat_arrays(known)
            order = np.argsort(h[fresh])
            to = np.searchsorted(self.hashes, h[fresh][order])
            self.hashes, self.piece = np.insert(self.hashes, to, h[fresh][order]), np.insert(self.piece, to, number[fresh][order])
        return number

    def _slice(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 1:
            cut[:-2] = (raw[:-1] == 32) & _AFTER[raw[1:]]
            # A blank that ends a text has nothing after it there.
            cut[off[1:] - 1] = False
        cut[off] = True
        at = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = pieces.dictionary_encode()
        number = self._numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.first[number + 1] - self.first[number]
        ends = np.cumsum(n)
        out = self.ids[np.arange(ends[-1]) + np.repeat(self.first[number] - (ends - n), n)]
        return out, np.concatenate(([0], ends))[np.searchsorted(at, off)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the n+1 places where each text's begin; a null or empty text has none."""
        if self.whole:
            ids, sizes = self._one_by_one([t or "" for t in texts.to_pylist()])
            return ids, np.concatenate(([0], np.cumsum(sizes)))
        raw, off = flat.buffers(texts)
        ids, places, total = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)], 0
        for i, j in flat.slices(off, 2 << 20):
            if off[i] == off[j]:
                places.append(np.full(j - i, total))
                continue
            part, at = self._slice(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            ids.append(part)
            places.append(at[1:] + total)
            total += len(part)
        return np.concatenate(ids), np.concatenate(places)

    def decode(self, ids) -> str:
        return self.tokenizer.decode([int(x) for x in ids])


_encoders: dict[bytes, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """An encoder that the process keeps."""
    key = hashlib.blake2b(data).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]
