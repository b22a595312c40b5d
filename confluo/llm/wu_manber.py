"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the windows of ``words`` consecutive words of each benchmark item, with one space between
words and around them. Items of ``LEAST_WORDS`` words or more that have no such window are one pattern as a whole. Texts are folded to the same
form: lower case, with what is neither letter, digit nor mark in Unicode turned into a space. Over the first m bytes of all patterns (m is
the shortest pattern) a shift table says, for the block of bytes that ends a window of text, how far the
window can move on without passing a match. Where it can't move, the block selects a bucket of
patterns; their first bytes and then all bytes are compared with the text.

The text of a batch is searched in many lanes at once, each lane moving by its own shifts. Patterns are places in the folded
text of the items, so what is kept is that text and some numbers for each window, however long its words are.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import flat
from confluo.llm.names import free_name
from confluo.session import cut

WORDS = 8
LEAST_WORDS = 5
SEARCH_BYTES = 2 << 20
LANES = 4096
#: Benchmark text that is broadcast and searched for at once; more of it takes more passes. A worker holds about twelve times this.
PASS_BYTES = 16 << 20

_OTHER = regex.compile(r"[^\p{L}\p{M}\p{N}]+")

_K = np.uint64(0x9E3779B97F4A7C15)


def unicode_fold(texts: pa.Array) -> pa.Array:
    """Texts with other characters than ASCII and Latin-1 letters in lower case, with spaces for what isn't a letter, digit or mark. Others as they are."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw, off = flat.buffers(texts)
    # Bytes over C3 begin other letters; C2 begins the signs of Latin-1; two signs are among its letters.
    odd = raw == 0xC2
    odd |= raw > 0xC3
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    odd[lead + 1] |= (raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7)
    at = np.flatnonzero(odd)
    some = np.unique(np.searchsorted(off, at, "right") - 1)
    if not len(some):
        return texts
    mask = np.zeros(len(texts), bool)
    mask[some] = True
    new = [_OTHER.sub(" ", t.lower()) for t in texts.take(pa.array(some)).to_pylist()]
    return pc.replace_with_mask(texts.cast(pa.large_string()), pa.array(mask), pa.array(new, pa.large_string()))


def normalise(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded words, each followed by one space; each text starts with a zero byte and a space."""
    folded = flat.fold(raw)
    starts, ends, doc = flat.words(folded, off)
    n = len(off) - 1
    size = ends - starts
    words = np.bincount(doc, minlength=n)
    bytes_ = flat.per_doc(size, np.concatenate(([0], np.cumsum(words)))) + words + 2
    base = np.concatenate(([0], np.cumsum(bytes_)))
    out = np.full(base[-1], 32, np.uint8)
    out[base[:-1]] = 0
    to = np.cumsum(size + 1) - (size + 1) + 2 * (doc + 1)
    out[np.arange(int(size.sum())) + np.repeat(to - (np.cumsum(size) - size), size)] = folded[folded != 32]
    return out, base


class Patterns:
    """Distinct windows of the items' folded text: where each starts and how long it is, and the items that it comes from."""

    def __init__(self, item_ids: Sequence, texts: pa.Array, words: int = WORDS, least: int = LEAST_WORDS):
        self.text, base = normalise(*flat.buffers(unicode_fold(texts)))
        starts, sizes, items = [], [], []
        gaps = np.flatnonzero(self.text == 32)
        for k in range(len(item_ids)):
            g = gaps[np.searchsorted(gaps, base[k]) : np.searchsorted(gaps, base[k + 1])]
            n = len(g) - 1
            if n < least:
                continue
            wide = min(words, n)
            first = g[: n - wide + 1]
            starts.append(first)
            sizes.append(g[wide:] - first + 1)
            items.append(np.full(len(first), k))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        start, size, item = join(starts), join(sizes), join(items)
        h = flat.span_hashes(self.text, start, start + size)
        order = np.lexsort((item, size, h))
        start, size, item, h = start[order], size[order], item[order], h[order]
        # Equal hashes are windows of equal text: sixty-four bits, and the lengths agree.
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (size[1:] != size[:-1])
        self.start, self.size = start[fresh], size[fresh]
        pair = np.unique((np.cumsum(fresh) - 1) << 32 | item) if len(item) else item
        self.item = pair & 0xFFFFFFFF
        self.first = np.searchsorted(pair >> 32, np.arange(len(self.start) + 1))

    def __len__(self) -> int:
        return len(self.start)

    def owners(self, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``pattern`` and the items (by their place in the table) that these patterns come from."""
        n = self.first[pattern + 1] - self.first[pattern]
        of = np.repeat(np.arange(len(pattern)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return of, self.item[self.first[pattern][of] + k]


class WuManber:
    def __init__(self, patterns: Patterns):
        self.patterns, size, start = patterns, patterns.size, patterns.start
        self.m = m = int(size.min(initial=1 << 30))
        if not len(patterns):
            return
        self.block = block = min(8, m)
        self.block_mask = np.uint64((1 << (8 * block)) - 1)
        # Eight bytes from each place on, past the end too.
        padded = np.concatenate((patterns.text, np.zeros(16, np.uint8)))
        self.code = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
        bits = int(np.clip(np.ceil(np.log2(16 * len(patterns) * (m - block + 1))), 12, 24))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, min(m - block + 1, 65535), np.uint16)
        for end in range(block, m + 1):
            h = self._hash(self.code[start + end - block] & self.block_mask)
            np.minimum.at(self.shift, h, min(m - end, 65535))
        self.by_suffix = np.argsort(h, kind="stable")
        self.suffix = h[self.by_suffix]

    def _hash(self, block: np.ndarray) -> np.ndarray:
        return ((block * _K) >> self.down).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where matches start, and of which pattern, in no particular order. ``text`` has no zero byte inside a match."""
        none = np.zeros(0, np.int64)
        n, m, block = len(text), self.m, getattr(self, "block", 0)
        if not len(self.patterns) or n < m:
            return none, none
        padded = np.concatenate((text, np.zeros(16, np.uint8)))
        at = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
        lanes = int(min(LANES, max(1, n // 512)))
        step = -(-n // lanes)
        begin = np.arange(0, n, step)
        pos = begin + m - 1
        stop = np.minimum(begin + step + m - 1, n)
        alive = pos < stop
        pos, stop = pos[alive], stop[alive]
        where, buckets = [], []
        while len(pos):
            h = self._hash(at[pos - block + 1] & self.block_mask)
            d = self.shift[h].astype(np.int64)
            hit = np.flatnonzero(d == 0)
            if len(hit):
                where.append(pos[hit])
                buckets.append(h[hit])
                d[hit] = 1
            pos = pos + d
            alive = pos < stop
            if not alive.all():
                pos, stop = pos[alive], stop[alive]
        if not where:
            return none, none
        start, h = np.concatenate(where) - m + 1, np.concatenate(buckets)
        left = np.searchsorted(self.suffix, h, "left")
        count = np.searchsorted(self.suffix, h, "right") - left
        start = np.repeat(start, count)
        k = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
        pattern = self.by_suffix[np.repeat(left, count) + k]
        # Eight bytes at a time, until each pattern is compared to its end; a match can't reach past the text, whose end is cut off first.
        size, begin = self.patterns.size, self.patterns.start
        inside = start + size[pattern] <= n
        start, pattern, done = start[inside], pattern[inside], 0
        found_start, found_pattern = [], []
        while len(start):
            left = size[pattern] - done
            mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * (left & 7).astype(np.uint64))) - np.uint64(1))
            same = (at[start + done] & mask) == (self.code[begin[pattern] + done] & mask)
            over = same & (left <= 8)
            found_start.append(start[over])
            found_pattern.append(pattern[over])
            same &= left > 8
            start, pattern, done = start[same], pattern[same], done + 8
        start, pattern = (np.concatenate(x) if x else none for x in (found_start, found_pattern))
        return start, pattern


_built: dict[str, WuManber] = {}


def _matches(texts: pa.Array, engine: WuManber) -> tuple[np.ndarray, np.ndarray]:
    """The text and the pattern of each match."""
    raw, off = flat.buffers(unicode_fold(texts))
    docs, pats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in flat.slices(off, SEARCH_BYTES):
        norm, base = normalise(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        start, pattern = engine.search(norm)
        docs.append(np.searchsorted(base, start, "right") - 1 + i)
        pats.append(pattern)
    return np.concatenate(docs), np.concatenate(pats)


def _numbers(items: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The distinct item ids and, for each row, the number of its id among them."""
    coded = items["id"].combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _finder(spark, items: pa.Table, words: int):
    """An Arrow UDF of texts: for each, the items found in it and how many windows of each."""
    sent = spark.sparkContext.broadcast(items)
    mark = uuid.uuid4().hex

    def find(texts: pa.Array) -> pa.Array:
        items = sent.value
        engine = _built.get(mark)
        if engine is None:
            # One pass at a time is kept, so that a worker's memory doesn't grow with their number.
            _built.clear()
            engine = _built[mark] = WuManber(Patterns(range(items.num_rows), items["text"], words))
        doc, pattern = _matches(texts, engine)
        of, row = engine.patterns.owners(pattern)
        # A window counts once for an item id, however many rows the item has.
        ids, item = _numbers(items)
        item = item[row]
        once = np.unique(np.column_stack((of, item)), axis=0) if len(of) else np.zeros((0, 2), np.int64)
        key, count = np.unique(doc[once[:, 0]] << 32 | once[:, 1], return_counts=True) if len(once) else (np.zeros(0, np.int64),) * 2
        offsets = np.searchsorted(key >> 32, np.arange(len(texts) + 1)).astype(np.int32)
        rows = pa.StructArray.from_arrays([ids.take(pa.array(key & 0xFFFFFFFF)), pa.array(count.astype(np.int64))], names=["item_id", "n_windows"])
        return pa.ListArray.from_arrays(pa.array(offsets), rows)

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, "array<struct<item_id:bigint,n_windows:bigint>>").asNondeterministic()


def _passes(docs: DataFrame, benchmark: DataFrame, words: int) -> list:
    """One finder for each part of the benchmark that fits a pass; all parts together are the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sizes = items.groupBy(F.col("id").alias("k")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    n = -(-total // PASS_BYTES) or 1
    if n == 1:
        return [_finder(docs.sparkSession, items.toArrow(), words)]
    # The rows of an id stay together, so that a window counts once for it, unless they are too many for a pass themselves.
    part = F.pmod(F.when(F.col("bytes") > PASS_BYTES, F.xxhash64("id", "text")).otherwise(F.xxhash64("id")), F.lit(n))
    parts = cut(items.join(sizes, F.col("id").eqNullSafe(F.col("k"))).select("id", "text", part.alias("part")))
    return [_finder(docs.sparkSession, parts.where(F.col("part") == k).select("id", "text").toArrow(), words) for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``item_id`` and ``n_windows``: how many windows of words of the document are in the item.

    Case, punctuation and spacing don't count, in any script. Null and empty texts, on either side, match nothing, and
    items of under five words say too little to be searched for. Texts and items of any length are read whole. Repeated documents give repeated rows; equal
    items are both reported; rows of one item id count as one item (of an id with more than ``PASS_BYTES`` of text, in parts). Null ids are carried.
    Other columns play no part. Empty tables give no rows.
    """
    out = None
    for udf in _passes(docs, benchmark, words):
        hits = docs.select(F.col("doc_id"), udf(F.col("text")).alias("__h")).where(F.size("__h") > 0)
        rows = hits.select("doc_id", F.explode("__h").alias("__h")).select("doc_id", "__h.item_id", "__h.n_windows")
        out = rows if out is None else out.unionByName(rows)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` in which :func:`find_contamination` finds nothing, all columns as they were."""
    for udf in _passes(docs, benchmark, words):
        hits = free_name(docs, "__confluo_hits")
        docs = docs.withColumn(hits, udf(F.col("text"))).where(F.size(hits) == 0).drop(hits)
    return docs


_WORDS_SQL = "string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')), ' ')"
#: Windows of eight words, and whole items of five to seven words.
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
dg AS (SELECT doc_id, r, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b)),
s AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS g FROM b WHERE len(w) BETWEEN 5 AND 7),
sg AS (SELECT doc_id, r, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM s)))
SELECT doc_id, item_id, count(*) AS n_windows FROM (SELECT doc_id, r, item_id FROM dg JOIN bg USING (g) UNION ALL SELECT doc_id, r, item_id FROM sg JOIN s USING (n, g)) GROUP BY doc_id, r, item_id
"""
