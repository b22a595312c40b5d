"""Best-fit packing of documents into training sequences by the sum-of-squares rule.

A bin is a sequence of ``capacity`` tokens. Each document goes where, afterwards, the sum over gaps h of
(number of open bins with h tokens left)**2 is least; a full bin has no gap and doesn't count. Among
equal choices the smallest gap that fits is taken, and of bins with that gap the one used last.

A document's tokens are its ids by a tokenizer and an end mark; without a tokenizer, its whitespace-separated words are counted. A document
of more than ``capacity`` tokens is cut: its full pieces each fill a bin, and the rest is packed like a document. The pieces of a bin, in
the order of their offsets, are a training sequence.

The table is split by hashed id into groups of about ``group_docs`` documents, each packed by one task, a document at a time as it is read.
The number of groups follows the number of rows, so that a task's work is the same at every size. Rows of an id that is on more rows
than a group has are spread over groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm import tokens
from confluo.session import cut

CAPACITY = 2048
GROUP_DOCS = 20_000
#: Ids up to this number are broadcast (about 50 MB); more than that go through a shuffled join.
BROADCAST_IDS = 2_000_000
SCHEMA = "bin_id bigint, doc_id bigint, piece int, n_tokens int, bin_offset int"


class SumOfSquares:
    """Open bins by gap, and the choice of a gap for the next item."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # count[0] stays 0: full bins don't count
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it for an item of ``size`` tokens, at most ``capacity``."""
        c, n = self.capacity, self.count
        # Change of the sum for a gap g with open bins: 2 (n[g-size] - n[g]) + 2, without the first part if g = size.
        gaps = np.flatnonzero(n[size:])
        change = 2 * (n[gaps] - n[gaps + size]) + 2
        if len(gaps) and gaps[0] == 0:
            change[0] = 1 - 2 * n[size]
        fresh = 0 if size == c else 2 * n[c - size] + 1
        best = int(np.argmin(change)) if len(gaps) else -1
        if best >= 0 and change[best] <= fresh:
            gap = int(gaps[best]) + size
            b = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, b = c, self.bins
            self.bins += 1
        if gap > size:
            self.open[gap - size].append(b)
            n[gap - size] += 1
        return b, c - gap


def place(rule: SumOfSquares, doc: int | None, size: int, out: dict[str, list], base: int = 0) -> None:
    """Put a document of ``size`` tokens, at least 1, in bins; a row of ``out`` for each piece."""
    full, rest = divmod(size, rule.capacity)
    for piece in range(full + (rest > 0)):
        part = rule.capacity if piece < full else rest
        b, at = rule.place(part)
        for k, v in zip(out, (base + b, doc, piece, part, at)):
            out[k].append(v)


def pack(ids: list, sizes: np.ndarray, capacity: int) -> dict[str, list]:
    """Columns bin, id, piece, size and offset, one row for each piece; items in the order given, whose sizes are at least 1."""
    rule = SumOfSquares(capacity)
    out: dict[str, list] = {k: [] for k in ("bin", "id", "piece", "size", "offset")}
    for doc, size in zip(ids, sizes.tolist()):
        place(rule, doc, size, out)
    return out


def token_count(text: Column) -> Column:
    """Words between whitespace, and one end mark; a null text has the mark only."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)) + 1).cast("int")


def _ids(sent: Broadcast):
    """An Arrow UDF of texts: the ids of each and the end mark, as bytes."""

    def run(texts: pa.Array) -> pa.Array:
        e = tokens.encoder(sent.value)
        ids, at = e.encode(texts)
        # The end mark goes behind each text.
        out = np.empty(len(ids) + len(texts), e.dtype)
        marks = at[1:] + np.arange(len(texts))
        rest = np.ones(len(out), bool)
        rest[marks] = False
        out[marks], out[rest] = e.end, ids
        ends = np.concatenate(([0], (marks + 1) * e.dtype.itemsize)).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary").asNondeterministic()


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, tokenizer: str | None = None) -> DataFrame:
    """``bin_id``, ``doc_id``, ``piece``, ``n_tokens`` and ``bin_offset``: where each piece of each document lies; with a tokenizer file, also
    the piece's ``tokens``.

    Every row of ``docs`` is packed, repeated ones as often as they occur. Null and empty texts take one
    token, the end mark. Null ids are carried. Within a group, documents come in the order of id and size, so equal
    sizes have one result. Texts of any length are packed whole. An empty table gives no rows. Other columns play no part.
    """
    if capacity < 1 or group_docs < 1:
        raise ValueError("capacity and group_docs are at least 1")
    spark = docs.sparkSession
    groups = -(-docs.select("doc_id").count() // group_docs) or 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Ids on more rows than a group has: at most a group_docs-th as many as there are rows.
    often = cut(rows.groupBy(F.col("doc_id").alias("k")).agg(F.ceil(F.count("*") / group_docs).cast("long").alias("spread")).where("spread > 1"))
    n_often = often.count()
    data, width = None, 0
    if tokenizer:
        sent = tokens.send(spark, tokenizer)
        data, width = _ids(sent), tokens.encoder(sent.value).dtype.itemsize
    sized = rows.select("doc_id", data(F.col("text")).alias("t")).select("doc_id", (F.octet_length("t") / width).cast("int").alias("n"), "t") if tokenizer else rows.select("doc_id", token_count(F.col("text")).alias("n"))
    key = [F.col("doc_id"), F.col("n")]
    if n_often:
        sized = sized.join(F.broadcast(often) if n_often <= BROADCAST_IDS else often, F.col("doc_id").eqNullSafe(F.col("k")), "left")
        key.append(F.pmod(F.monotonically_increasing_id(), F.coalesce("spread", F.lit(1))))
    grouped = sized.withColumn("g", F.pmod(F.xxhash64(*key), F.lit(groups)).cast("long")).select("g", "doc_id", "n", *(["t"] if tokenizer else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rule = None, None
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("bin", "id", "piece", "size", "offset")}
            for g, doc, size in zip(*(batch.column(c).to_pylist() for c in ("g", "doc_id", "n"))):
                if g != now:
                    now, rule = g, SumOfSquares(capacity)
                place(rule, doc, size, out, g << 32)
            cols = [pa.array(out[k], pa.int64()) for k in ("bin", "id")] + [pa.array(out[k], pa.int32()) for k in ("piece", "size", "offset")]
            if width:
                # Pieces come in the order of the batch's rows, so their ends cut its ids.
                raw = batch.column("t").cast(pa.large_binary())
                data = np.frombuffer(raw.buffers()[2], np.uint8) if len(raw) else np.zeros(0, np.uint8)
                at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
                ids = data[at[0] : at[-1]].view(f"<u{width}").astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(out["size"]))), pa.int32()), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(cols, names=["bin_id", "doc_id", "piece", "n_tokens", "bin_offset"] + ["tokens"] * bool(width))

    return grouped.repartition(groups, "g").sortWithinPartitions("g", "doc_id", "n", *(["t"] if tokenizer else [])).mapInArrow(run, SCHEMA + (", tokens array<int>" if tokenizer else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """A row a bin of :func:`pack_documents` with tokens: ``bin_id``, ``n_tokens``, its ``tokens``, and ``doc_ids`` and ``starts``, which say where each piece begins."""
    pieces = F.sort_array(F.collect_list(F.struct("bin_offset", "doc_id", "tokens")))
    rows = packed.groupBy("bin_id").agg(F.sum("n_tokens").cast("int").alias("n_tokens"), pieces.alias("p"))
    return rows.select("bin_id", "n_tokens", F.flatten("p.tokens").alias("tokens"), F.col("p.doc_id").alias("doc_ids"), F.col("p.bin_offset").alias("starts"))
