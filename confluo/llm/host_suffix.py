"""HTML extraction: text without what repeats across the pages of a host, by host suffix arrays.

The text of each page becomes a stream of tokens. The streams of a host are put one after the other, and their suffixes
are sorted by prefix doubling as deep as ``least`` tokens. Neighbours that agree so far, from distinct pages, are
a repeated substring; longer ones are chains of these. Tokens that one covers are boilerplate and go; what
is left are the unique runs. Pages of equal text count as one page, so that copies don't wipe each other out.

A host of up to ``HOST_BYTES`` of HTML is sorted by one task. Of a larger one, the suffixes are dealt out by a 64-bit
hash of their first ``least`` tokens, so that each task sorts one class of prefixes of all its pages;
the repeated ones go back to the pages that hold them. Both ways find the same. Of a hash, the class and 56 more bits
count; as a class has about four million suffixes at any size of host, two differ by chance in all but one of 10**10.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import flat
from confluo.session import cut

LEAST = 10
HOST_BYTES = 16 << 20
#: HTML whose suffixes one task sorts when a host is dealt out.
PART_BYTES = 32 << 20
#: Large hosts up to this number are broadcast (a few MB); more are joined by a shuffle.
BROADCAST_HOSTS = 50_000
#: Pages are handled this many at once within a batch.
AT_ONCE = 2000
SCHEMA = "page_id bigint, host string, n_tokens int, n_removed int, text string"
_ARROW = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("n_tokens", pa.int32()), ("n_removed", pa.int32()), ("text", pa.string())])

_BLOCK = "body|p|div|h[1-6]|ul|ol|li|dl|table|article|section|main|header|footer|nav|aside|form|blockquote|pre|hr|figure|address|fieldset|center"
#: What holds no visible text. Without an end tag, the first kind goes on to the end of the page, as in a browser; the second is taken as it
#: stands; the third ends at the next block.
_RAW, _OPTIONAL, _BREAKABLE = ("script", "style", "textarea", "iframe"), ("noscript", "template"), ("svg", "select", "title")
_OPEN = re.compile(rf"(?i)<!--|<({'|'.join(_RAW + _OPTIONAL + _BREAKABLE)})\b[^<>]*>?")
_CLOSE = {n: re.compile(rf"(?i)</{n}\s*>") for n in _RAW + _OPTIONAL} | {n: re.compile(rf"(?i)</{n}\s*>|(?=<(?:{_BLOCK}|/head)\b)") for n in _BREAKABLE}
_INLINE = re.compile(r"(?i)</?(?:a|abbr|b|bdi|bdo|big|cite|code|em|font|i|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?>")
_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>?")
_SPACES = re.compile(r"[^\S\n]+")
_BREAKS = re.compile(r"\s*\n\s*")


def _visible(page: str) -> str:
    """The page without comments and elements that hold no visible text. Nothing is scanned twice, so the time is linear."""
    out, at, endless = [], 0, set()
    while m := _OPEN.search(page, at):
        out += [page[at : m.start()], "\n"]
        name = m[1].lower() if m[1] else None
        if name is None:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            continue
        end = None if name in endless else _CLOSE[name].search(page, m.end())
        if end:
            at = end.end()
        elif name in _OPTIONAL:
            endless.add(name)
            at = m.end()
        else:
            at = len(page)
    return "".join([*out, page[at:]])


def extract(page: str | None) -> str:
    """Visible text of a page, one line a block, one space between words. Null and empty pages give an empty text. Missing end tags lose no block that follows."""
    if not page:
        return ""
    text = _TAG.sub("\n", _INLINE.sub("", _visible(page.replace("\n", " ").replace("\0", " "))))
    return _BREAKS.sub("\n", _SPACES.sub(" ", html_lib.unescape(text))).strip()


class Streams:
    """Tokens of some texts: where they start and end in the bytes, their text and their hashes."""

    def __init__(self, texts: list[str]):
        self.raw, self.off = flat.buffers(pa.array(texts, pa.large_string()))
        starts, ends, page, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, j in flat.slices(self.off):
            raw, at = self.raw[self.off[i] : self.off[j]], int(self.off[i])
            s, e, d = flat.words(np.where(raw <= 32, np.uint8(32), raw), self.off[i : j + 1] - at)
            hashes.append(flat.span_hashes(raw, s, e))
            starts.append(s + at)
            ends.append(e + at)
            page.append(d + i)
        self.starts, self.ends, self.page, self.hash = (np.concatenate(x) for x in (starts, ends, page, hashes))
        self.first = np.searchsorted(self.page, np.arange(len(texts) + 1))

    def valid(self, least: int) -> np.ndarray:
        """Tokens at which ``least`` tokens of one page start."""
        return np.flatnonzero(self.first[self.page + 1] - np.arange(len(self.page)) >= least)

    def cover(self, at: np.ndarray, least: int) -> np.ndarray:
        """Tokens that lie in windows of ``least`` tokens that start at ``at``."""
        edge = np.zeros(len(self.page) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + least, -1)
        return np.cumsum(edge)[:-1] > 0

    def unique_runs(self, covered: np.ndarray, page: int) -> tuple[int, int, str]:
        """Number of tokens of a page, of those removed, and the text that stays, runs parted by newlines."""
        a, b = int(self.first[page]), int(self.first[page + 1])
        gone = covered[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
        runs = [bytes(self.raw[self.starts[a + i] : self.ends[a + j - 1]]) for i, j in zip(edges[::2], edges[1::2])]
        return b - a, int(gone.sum()), b"\n".join(runs).decode()

    def window_hashes(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows of ``least`` tokens, and their 64-bit hashes."""
        at, out = self.valid(least), []
        h = flat.mix(self.hash, 31)
        for k in range(0, len(at), 1 << 18):
            part = at[k : k + (1 << 18)]
            total = np.zeros(len(part), np.uint64)
            for j in range(least):
                total = flat.mix(total ^ h[part + j])
            out.append(total)
        return at, np.concatenate(out) if out else np.zeros(0, np.uint64)


def repeated(token: np.ndarray, page: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Those of the suffixes ``at`` whose first ``least`` tokens also start a suffix in another page.

    Suffixes are ranked by 1, 2, 4, ... tokens; two overlapping ranks then reach ``least``.
    """
    if not len(at):
        return at
    rank, k = np.unique(token, return_inverse=True)[1].astype(np.int64), 1
    some = at
    while True:
        step = min(k, least - k)
        if step:
            wide = np.zeros(len(rank), np.int64)
            # A rank reaches k tokens; where the text of a page ends sooner no suffix of `at` asks for it.
            start = np.arange(len(rank) - step)
            wide[: len(start)] = rank[start] * (rank.max() + 1) + rank[start + step]
            rank, k = np.unique(wide, return_inverse=True)[1].astype(np.int64), k + step
        if k >= least:
            break
    order = np.argsort(rank[some], kind="stable")
    suffixes = some[order]
    first = np.flatnonzero(np.diff(rank[suffixes], prepend=-1))
    low, high = np.minimum.reduceat(page[suffixes], first), np.maximum.reduceat(page[suffixes], first)
    return suffixes[np.repeat(low != high, np.diff(np.append(first, len(suffixes))))]


def clean_host(texts: list[str], least: int = LEAST) -> list[tuple[int, int, str]]:
    """(tokens, removed tokens, text) for each text of a host."""
    number: dict[str, int] = {}
    which = [number.setdefault(t, len(number)) for t in texts]
    s = Streams(list(number))
    covered = s.cover(repeated(s.hash, s.page, s.valid(least), least), least)
    done = [s.unique_runs(covered, k) for k in range(len(number))]
    return [done[k] for k in which]


_LOW = np.uint64((1 << 56) - 1)


def _fingerprint(rest: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    return flat.mix(rest ^ flat.mix(np.asarray(part).astype(np.uint64).reshape(-1), 9))


def _seven(h: np.ndarray) -> bytes:
    """56-bit numbers as seven bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _eight(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view("<u8")[:, 0]


def _put(ids: list, texts: list[str]) -> bytes:
    data = [t.encode() for t in texts]
    head = np.array([len(ids)], np.int64).tobytes() + np.array([x or 0 for x in ids], np.int64).tobytes() + np.array([x is None for x in ids], np.uint8).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + np.array([len(d) for d in data], np.int64).tobytes() + b"".join(data))


def _get(blob: bytes) -> tuple[list, list[str]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, null = np.frombuffer(raw, np.int64, n, 8).tolist(), np.frombuffer(raw, np.uint8, n, 8 + 8 * n)
    at = np.concatenate(([0], np.cumsum(np.frombuffer(raw[8 + 9 * n : 8 + 17 * n], np.int64)))) + 8 + 17 * n
    return [None if z else x for x, z in zip(ids, null)], [raw[a:b].decode() for a, b in zip(at[:-1], at[1:])]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None], list[str]]]:
    """Ids, hosts and texts of the pages of some batches."""
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(k, AT_ONCE)
            yield part.column("page_id").to_pylist(), part.column("host").to_pylist(), [extract(x) for x in part.column("html").to_pylist()]


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + AT_ONCE]), _ARROW)], schema=_ARROW)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys. A run is held as a whole."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, texts in _chunks(batches):
        yield from _rows([(i, None, len(t.split()), 0, t) for i, t in zip(ids, texts)])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the pages of each host within a batch."""
    for batch in batches:
        by: dict[str, tuple[list, list]] = {}
        for ids, hosts, texts in _chunks(iter([batch])):
            for i, h, t in zip(ids, hosts, texts):
                have = by.setdefault(h, ([], []))
                have[0].append(i)
                have[1].append(t)
        yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([_put(*v) for v in by.values()], pa.binary())], names=["host", "blob"])


def _sorter(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host,), rows in _groups(batches, ["host"]):
            ids, texts = [], []
            for row in rows:
                a, b = _get(row["blob"])
                ids += a
                texts += b
            yield from _rows([(i, host, *done) for i, done in zip(ids, clean_host(texts, least))])

    return run


def _text_keys(texts: list[str]) -> np.ndarray:
    raw, off = flat.buffers(pa.array(texts, pa.large_string()))
    parts = [flat.span_hashes(raw[off[i] : off[j]], off[i:j] - off[i], off[i + 1 : j + 1] - off[i]) for i, j in flat.slices(off)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _dealer(least: int, parts_of: str = "parts") -> Callable:
    """Deals out the suffixes of each batch: for a host and a range of hashes, the keys of its pages, how many suffixes of each, and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, texts = [], [], []
            for a, b, c in _chunks(iter([batch])):
                ids, hosts, texts = ids + a, hosts + b, texts + c
            parts = dict(zip(hosts, batch.column(parts_of).to_pylist()))
            hosts_, keys = np.array(hosts, object), _text_keys(texts)
            out: dict[str, list] = {"host": [], "part": [], "blob": []}
            for host, n in parts.items():
                mine = np.flatnonzero(hosts_ == host)
                mine = mine[np.unique(keys[mine], return_index=True)[1]]
                s = Streams([texts[k] for k in mine])
                at, h = s.window_hashes(least)
                page = s.page[at]
                part, h = (h % np.uint64(n)).astype(np.int64), h // np.uint64(n) & _LOW
                order = np.lexsort((h, page, part))
                page, h, part = page[order], h[order], part[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (page[1:] != page[:-1])
                page, h, part = page[fresh], h[fresh], part[fresh]
                edges = np.searchsorted(part, np.arange(n + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    a, b = edges[p], edges[p + 1]
                    there, count = np.unique(page[a:b], return_counts=True)
                    out["host"].append(host)
                    out["part"].append(int(p))
                    out["blob"].append(np.array([len(there)], np.int64).tobytes() + keys[mine[there]].tobytes() + count.astype(np.int32).tobytes() + _seven(h[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(out["host"], pa.string()), pa.array(out["part"], pa.int64()), pa.array(out["blob"], pa.binary())], names=["host", "part", "blob"])

    return run


def _meeting(buckets: int) -> Callable:
    """Sorts the suffixes of a host in a range of hashes; gives each bucket of pages those of its hashes that are in two pages or more, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, part), rows in _groups(batches, ["host", "part"]):
            keys, hashes = [], []
            for row in rows:
                raw = row["blob"]
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                keys.append(np.repeat(np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, np.int32, n, 8 + 8 * n)))
                hashes.append(_eight(raw[8 + 12 * n :]))
            rows.clear()
            key, h = np.concatenate(keys), _fingerprint(np.concatenate(hashes), part)
            del keys, hashes
            order = np.argsort(h, kind="stable")
            key, h = key[order], h[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            both = np.repeat(np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first), np.diff(np.append(first, len(h))))
            bucket, h = (key[both] % np.uint64(buckets)).astype(np.int64), h[both]
            order = np.lexsort((h, bucket))
            bucket, h = bucket[order], h[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
            bucket, h = bucket[fresh], h[fresh]
            if len(h):
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                data = [x.tobytes() for x in np.split(h, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(first), pa.string()), pa.array(bucket[first]), pa.array(data, pa.binary())], names=["host", "bucket", "hits"])

    return run


def _keyed(buckets: int) -> Callable:
    """One row for the pages of each host and bucket of keys within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[tuple, tuple[list, list]] = {}
            parts = dict(zip(batch.column("host").to_pylist(), batch.column("parts").to_pylist()))
            for ids, hosts, texts in _chunks(iter([batch])):
                for i, h, t, b in zip(ids, hosts, texts, (_text_keys(texts) % np.uint64(buckets)).tolist()):
                    have = by.setdefault((h, b), ([], []))
                    have[0].append(i)
                    have[1].append(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in by], pa.string()), pa.array([k[1] for k in by], pa.int64()), pa.array([parts[k[0]] for k in by], pa.int64()), pa.array([_put(*v) for v in by.values()], pa.binary())],
                names=["host", "bucket", "parts", "blob"],
            )

    return run


def _applier(least: int) -> Callable:
    """Hashes of a host and bucket, which come first, and the pages that they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashes, wanted = None, [], None
        for batch in batches:
            for host, bucket, n_parts, blob, hits in zip(*(batch.column(c).to_pylist() for c in ("host", "bucket", "parts", "blob", "hits"))):
                if (host, bucket) != now:
                    now, hashes, wanted = (host, bucket), [], None
                if hits is not None:
                    hashes.append(np.frombuffer(hits, np.uint64))
                    continue
                if wanted is None:
                    wanted = np.sort(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
                ids, texts = _get(blob)
                s = Streams(texts)
                at, h = s.window_hashes(least)
                h = _fingerprint(h // np.uint64(n_parts) & _LOW, h % np.uint64(n_parts))
                place = np.searchsorted(wanted, h)
                hit = wanted[np.minimum(place, len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
                covered = s.cover(at[hit], least)
                yield from _rows([(i, host, *s.unique_runs(covered, k)) for k, i in enumerate(ids)])

    return run


def extract_pages(pages: DataFrame, *, least: int = LEAST, host_bytes: int = HOST_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``page_id``, ``host``, ``n_tokens``, ``n_removed`` and ``text`` of every page.

    ``text`` are the runs of tokens that no substring of ``least`` tokens or more, found in another page of the host, covers.
    A page whose URL is null or has no host is compared with none, and its host is null. Null, empty and
    tag-only pages have an empty text. Repeated rows, and pages of equal text, aren't distinct pages and have equal results.
    Null ids are carried; the order of rows and ties don't matter; other columns, whatever their names, play
    no part; an empty table gives no rows. Pages of any length are read whole, in linear time.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))).alias("host"), F.col("html").cast("string").alias("html"))
    spark = pages.sparkSession
    sizes = cut(rows.where("host is not null").groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes")))
    parts = sizes.where(F.col("bytes") > host_bytes).select("host", F.ceil(F.col("bytes") / part_bytes).cast("long").alias("parts"))
    total, n_large, n_parts = (x or 0 for x in sizes.join(parts, "host", "left").agg(F.sum("bytes"), F.count("parts"), F.sum("parts")).first())
    # Tasks grow in number with the bytes, so that what one takes doesn't.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    out = rows.where("host is null").mapInArrow(_alone, SCHEMA)
    if n_large <= BROADCAST_HOSTS:
        parts = F.broadcast(parts)
    named = rows.where("host is not null")
    small = named.join(parts, "host", "left_anti") if n_large else named
    gathered = small.mapInArrow(_gather, "host string, blob binary")
    out = out.unionByName(gathered.repartition(tasks, "host").sortWithinPartitions("host").mapInArrow(_sorter(least), SCHEMA))
    if n_large:
        large = named.join(parts, "host")
        dealt = large.mapInArrow(_dealer(least), "host string, part bigint, blob binary")
        buckets = max(n_parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
        hits = dealt.repartition(max(tasks, n_parts), "host", "part").sortWithinPartitions("host", "part").mapInArrow(_meeting(buckets), "host string, bucket bigint, hits binary")
        back = hits.select("host", "bucket", F.lit(None).cast("bigint").alias("parts"), F.lit(None).cast("binary").alias("blob"), "hits")
        kept = large.mapInArrow(_keyed(buckets), "host string, bucket bigint, parts bigint, blob binary").withColumn("hits", F.lit(None).cast("binary"))
        both = back.unionByName(kept).withColumn("page", F.col("hits").isNull())
        out = out.unionByName(both.repartition(tasks, "host", "bucket").sortWithinPartitions("host", "bucket", "page").drop("page").mapInArrow(_applier(least), SCHEMA))
    return out
