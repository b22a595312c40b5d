"""Near-duplicates by 128-bit SimHash, searched through a Gray-order hierarchical index.

A fingerprint has one bit for each of 128 weighted votes of a text's distinct words; longer words, which
are rarer, weigh more; a text of under ``LEAST_WORDS`` words gets a hash of its words in order. Two texts are near copies if their fingerprints differ in at most ``most`` bits.

Search: bit samples send each fingerprint to one bucket in each of some tables, so that only rows that agree on a sample meet, on
whatever executor. A sample has more bits the more fingerprints there are, so that a bucket of unrelated ones holds about
``BUCKET`` of them at any size, and the number of tables follows, so that a pair at distance ``most`` meets in one of them with
probability ``RECALL`` or more, and nearer pairs with more. At distance d a pair is missed by all tables with probability
(1 - (1 - d/128)**bits)**tables.

Inside a bucket the fingerprints are sorted by Gray rank and become leaves of an index. A node above them holds the bits on which all
below agree (a mask and a pattern). The join walks pairs of nodes downwards. Each level adds only the differences in bits that its parents
did not share, and a pair of groups is dropped as soon as the sum passes ``most``.

In a crowded bucket, rows near one member, a pivot, are linked to it and so to each other; nodes of the index that lie within such a
group carry it, and pairs of nodes whose groups are linked already are dropped. Dense groups of copies so cost little more than their
size. The rows of a bucket of more than ``HOT`` are dealt out: those near the bucket's pivot (the member nearest to its majority of bits)
in slices, the others in slices that meet each other and each of the first, so that no task holds more than two slices and no pair is left out.

All links found become edges of one graph whose components are the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from confluo.llm import flat
from confluo.llm.names import free_name
from confluo.operators.components import connected_components
from confluo.session import cut

MOST = 20
#: Least probability that a pair at distance ``MOST`` meets.
RECALL = 0.99
#: Unrelated fingerprints in a bucket.
BUCKET = 64
FAN = 8
#: Rows of a bucket that one task holds at once; larger buckets are dealt out in slices of this size.
HOT = 100_000
#: Rows of tables that a task of the search takes.
TASK_ROWS = 2_000_000
#: A text with fewer words is near only to texts with the same words in the same order.
LEAST_WORDS = 8
PAIRS_AT_ONCE = 1 << 20
#: Buckets of more rows than this are looked through for pivots, until this many of them have few neighbours.
CROWD, MISSES = 256, 8
#: Ids up to this number are broadcast (about 50 MB); more than that go through a shuffled join.
BROADCAST_IDS = 2_000_000


def _fingerprints(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(off) - 1
    folded = flat.fold(raw)
    starts, ends, doc_of_word = flat.words(folded, off)
    out = np.zeros((n, 16), np.uint8)
    some = np.zeros(n, bool)
    if not len(starts):
        return out, some
    h = flat.span_hashes(folded, starts, ends)
    length = np.minimum(ends - starts, 10).astype(np.uint64)
    # Sixteen bits of document, 44 of hash and four of length, so that one sort finds the distinct words.
    key = np.unique((doc_of_word.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(20) << np.uint64(4)) | length)
    doc = (key >> np.uint64(48)).astype(np.int64)
    word, size = key >> np.uint64(4) & np.uint64((1 << 44) - 1), (key & np.uint64(15)).astype(np.int64)
    weight = np.where(size > 3, 3 * (size - 2), 1).astype(np.uint8)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    there = doc[first]
    for half in (0, 1):
        bits = np.unpackbits(flat.mix(word, half + 1).view(np.uint8).reshape(-1, 8), axis=1)
        bits *= weight[:, None]
        votes = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        total = np.add.reduceat(weight, first, dtype=np.int64)
        out[there, 8 * half : 8 * half + 8] = np.packbits(2 * votes > total[:, None], axis=1)
    some[there] = True
    n_words = np.bincount(doc_of_word, minlength=n)
    begin = np.cumsum(n_words) - n_words
    place = (np.arange(len(h)) - begin[doc_of_word]).astype(np.uint64)
    brief = np.flatnonzero(some & (n_words < LEAST_WORDS))
    for half in (0, 1):
        if len(brief):
            pick = np.isin(doc_of_word, brief)
            placed = flat.mix(h[pick] + place[pick] * np.uint64(0xD6E8FEB86659FD93), half + 3)
            whole = np.add.reduceat(placed, np.flatnonzero(np.diff(doc_of_word[pick], prepend=-1)))
            out[brief, 8 * half : 8 * half + 8] = flat.mix(whole).view(np.uint8).reshape(-1, 8)
    return out, some


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low halves of each text's fingerprint, and whether it has one (whether it has a word)."""
    raw, off = flat.buffers(texts)
    parts = [_fingerprints(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in flat.slices(off)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    code = np.ascontiguousarray(np.concatenate([p[0] for p in parts])).view(">i8").astype(np.int64)
    return code[:, 0], code[:, 1], np.concatenate([p[1] for p in parts])


def gray_rank(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The position of each 128-bit code in Gray order, as two words."""
    a, b = hi.copy(), lo.copy()
    for s in (1, 2, 4, 8, 16, 32):
        a ^= a >> np.uint64(s)
        b ^= b >> np.uint64(s)
    return a, np.where(a & np.uint64(1), ~b, b)


class GrayIndex:
    """Levels of nodes over fingerprints sorted by bucket and Gray rank; level 0 are the fingerprints."""

    def __init__(self, bucket: np.ndarray, hi: np.ndarray, lo: np.ndarray, group: np.ndarray | None = None):
        """``group`` numbers rows that are linked already, -1 for none; rows of a group lie side by side."""
        rank = gray_rank(hi, lo)
        group = np.full(len(hi), -1) if group is None else group
        self.order = np.lexsort((rank[1], rank[0], group, bucket))
        self.group = [group[self.order]]
        ones = np.full(len(hi), ~np.uint64(0))
        self.mask, self.pattern, self.child = [(ones, ones)], [(hi[self.order], lo[self.order])], [None]
        b = bucket[self.order]
        while True:
            start = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(b)))
            if (self.child[-1] is not None or not len(b)) and size.max(initial=1) == 1:
                break
            within = np.arange(len(b)) - np.repeat(start, size)
            first = np.flatnonzero(within % FAN == 0)
            masks, patterns = [], []
            for m, p in zip(self.mask[-1], self.pattern[-1]):
                all_, any_ = np.bitwise_and.reduceat(p, first), np.bitwise_or.reduceat(p, first)
                m = np.bitwise_and.reduceat(m, first) & ~(all_ ^ any_)
                masks.append(m)
                patterns.append(all_ & m)
            self.mask.append(tuple(masks))
            self.pattern.append(tuple(patterns))
            least, most = (f.reduceat(self.group[-1], first) for f in (np.minimum, np.maximum))
            self.group.append(np.where(least == most, least, -1))
            self.child.append((first, np.diff(np.append(first, len(b)))))
            b = b[first]
        self.roots = b

    def lift(self, top: int) -> None:
        """Levels up to ``top``, by roots with one child each."""
        while len(self.child) <= top:
            n = len(self.mask[-1][0])
            self.mask.append(self.mask[-1])
            self.pattern.append(self.pattern[-1])
            self.group.append(self.group[-1])
            self.child.append((np.arange(n), np.ones(n, np.int64)))

    def pairs(self, most: int, other: GrayIndex | None = None, linked: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs of rows, as they were given, that share a bucket and differ in at most ``most`` bits; of this index, or of this and another.

        ``linked`` says which of some pairs of groups needn't be compared any more; it is asked before each block.
        """
        one = other is None
        other = self if one else other
        top = max(len(self.child), len(other.child)) - 1
        self.lift(top)
        other.lift(top)
        if top < 1:
            return
        if one:
            a = b = np.arange(len(self.roots))
        else:
            _, a, b = np.intersect1d(self.roots, other.roots, assume_unique=True, return_indices=True)
        # What roots share already counts against the pair.
        spent = np.zeros(len(a), np.int64)
        if not one:
            for w in (0, 1):
                spent += np.bitwise_count((self.pattern[top][w][a] ^ other.pattern[top][w][b]) & self.mask[top][w][a] & other.mask[top][w][b])
        ok = spent <= most
        todo = [(top, a[ok], b[ok], spent[ok])]
        while todo:
            level, a, b, spent = todo.pop()
            if linked:
                g, h = self.group[level][a], other.group[level][b]
                both = np.flatnonzero((g >= 0) & (h >= 0))
                open_ = np.ones(len(a), bool)
                open_[both] = ~linked(g[both], h[both])
                a, b, spent = a[open_], b[open_], spent[open_]
            if not len(a):
                continue
            if level == 0:
                yield self.order[a], other.order[b]
                continue
            first, size = self.child[level]
            first_, size_ = other.child[level]
            n = size[a] * size_[b]
            ends = np.cumsum(n)
            if len(n) > 1 and ends[-1] > PAIRS_AT_ONCE:
                half = min(max(int(np.searchsorted(ends, ends[-1] // 2)), 1), len(n) - 1)
                todo += [(level, a[half:], b[half:], spent[half:]), (level, a[:half], b[:half], spent[:half])]
                continue
            of = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(of)) - np.repeat(ends - n, n)
            i, j = first[a][of] + k // size_[b][of], first_[b][of] + k % size_[b][of]
            if one:
                right = (a[of] != b[of]) | (i < j if level == 1 else i <= j)
                of, i, j = of[right], i[right], j[right]
            total = spent[of]
            for w in (0, 1):
                fresh = self.mask[level - 1][w][i] & other.mask[level - 1][w][j] & ~(self.mask[level][w][a[of]] & other.mask[level][w][b[of]])
                total = total + np.bitwise_count((self.pattern[level - 1][w][i] ^ other.pattern[level - 1][w][j]) & fresh)
            ok = total <= most
            if ok.any():
                todo.append((level - 1, i[ok], j[ok], total[ok]))


def forest(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n rows the least row that it is linked to, directly or not."""
    label = np.arange(n) if label is None else label
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def peel(bucket: np.ndarray, hi: np.ndarray, lo: np.ndarray, most: int) -> np.ndarray:
    """For rows sorted by bucket, the pivot that each is near in a crowded bucket, or -1. A pivot is a row of the bucket; it is near itself."""
    out = np.full(len(bucket), -1)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(bucket)))
    left, missed = np.flatnonzero(np.repeat(size > CROWD, size)), np.zeros(len(first), np.int64)
    of = np.repeat(np.arange(len(first)), size)
    while len(left):
        start = np.flatnonzero(np.append(True, of[left[1:]] != of[left[:-1]]))
        pivot = np.repeat(left[start], np.diff(np.append(start, len(left))))
        near = np.bitwise_count(hi[left] ^ hi[pivot]) + np.bitwise_count(lo[left] ^ lo[pivot]) <= most
        many = np.bincount(of[left[near]], minlength=len(first)) >= 8
        out[left[near]] = np.where(many[of[left[near]]], pivot[near], -1)
        missed += ~many
        left = left[~near & (missed[of[left]] < MISSES)]
    return out


def links(bucket: np.ndarray, hi: np.ndarray, lo: np.ndarray, most: int, core: np.ndarray | None = None) -> np.ndarray:
    """For each of some rows sorted by bucket the least row that it is linked to.

    Given ``core``, rows that are linked to one another elsewhere, these are only compared with the others, and the others only with these.
    """
    n = len(bucket)
    group = peel(bucket, hi, lo, most)
    if core is not None and core.any():
        # The rows of a core are one group in each bucket.
        some = np.flatnonzero(core)
        start = np.flatnonzero(np.append(True, bucket[some[1:]] != bucket[some[:-1]]))
        group[some] = np.repeat(some[start], np.diff(np.append(start, len(some))))
        apart = np.isin(group, some) & ~core
        group[apart] = -1
    tied = np.flatnonzero(group >= 0)
    label = forest(n, tied, group[tied])
    linked = lambda g, h: label[g] == label[h]
    if core is None:
        for i, j in GrayIndex(bucket, hi, lo, group).pairs(most, None, linked):
            label = forest(n, i, j, label)
        return label
    a, b = np.flatnonzero(core), np.flatnonzero(~core)
    for i, j in GrayIndex(bucket[a], hi[a], lo[a], group[a]).pairs(most, GrayIndex(bucket[b], hi[b], lo[b], group[b]), linked):
        label = forest(n, a[i], b[j], label)
    return label


#: What a row is in its task: one of a whole bucket; one of two slices that meet; one near the pivot, and one that isn't, of slices that meet.
WHOLE, SLICE, CORE, OTHER = range(4)


def _linker(most: int, hot: int):
    """Reads rows sorted by key; gives, for whole keys at a time, edges from each row to the least node that it is linked to."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, now = 0, None

        def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, node, role = t["key"].to_numpy(), t["node"].to_numpy(), t["role"].to_numpy()
            hi, lo = t["hi"].to_numpy().view(np.uint64), t["lo"].to_numpy().view(np.uint64)
            for meets in (False, True):
                pick = np.flatnonzero((role >= CORE) == meets)
                if not len(pick):
                    continue
                label, mine = links(key[pick], hi[pick], lo[pick], most, role[pick] == CORE if meets else None), node[pick]
                least = mine.copy()
                np.minimum.at(least, label, mine)
                least = least[label]
                moved = least != mine
                if moved.any():
                    yield pa.RecordBatch.from_arrays([pa.array(mine[moved]), pa.array(least[moved])], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            # What is held can be worked off up to where a key ends: where the last one of this batch starts, if it starts here.
            ends = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else -1 if now == key[0] else 0
            if ends >= 0 and rows + ends >= hot:
                done = [*held, pa.Table.from_batches([batch.slice(0, ends)])] if ends else held
                yield from run(pa.concat_tables(done))
                held, rows, batch = [], 0, batch.slice(ends)
            held.append(pa.Table.from_batches([batch]))
            rows, now = rows + batch.num_rows, key[-1]
        if rows:
            yield from run(pa.concat_tables(held))

    return link


def plan(n: int, most: int = MOST, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(tables, bits a sample) for ``n`` fingerprints."""
    sample = int(min(max(round(np.log2(max(n, 1) / bucket)), 4), 64))
    meet = (1 - most / 128) ** sample
    return max(int(np.ceil(np.log(1 - recall) / np.log1p(-meet))), 1) if meet < 1 else 1, sample


def samples(tables: int, sample: int) -> list[tuple[int, int]]:
    """Two 64-bit masks, as signed integers, with ``sample`` bits set between them, for each table."""
    rng = np.random.default_rng(128)
    out, left = [], []
    for _ in range(tables):
        if len(left) < sample:
            left = list(rng.permutation(128))
        bits = [int(x) for x in left[:sample]]
        left = left[sample:]
        words = [sum(1 << (x % 64) for x in bits if x // 64 == w) for w in (0, 1)]
        out.append(tuple(int(np.uint64(w).astype(np.int64)) for w in words))
    return out


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """``id``, ``hi`` and ``lo`` of each row; the halves are null for a text without words."""

    def fp(texts: pa.Array) -> pa.Array:
        hi, lo, some = fingerprints(texts)
        return pa.StructArray.from_arrays([pa.array(hi, mask=~some), pa.array(lo, mask=~some)], names=["hi", "lo"])

    fp.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(fp, "struct<hi:bigint,lo:bigint>").asNondeterministic()
    return docs.select(F.col("doc_id").alias("id"), udf(F.col("text")).alias("f")).select("id", "f.hi", "f.lo")


def _bits(hi: str, lo: str) -> list[str]:
    return [f"{w} >> {k} & 1" for w in (hi, lo) for k in range(64)]


def _crowded(rows: DataFrame, total: int, most: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Keys of buckets of over ``hot`` rows, the edges to their pivots, and their rows dealt out; None if there are none.

    Keys are counted by cell first, which shuffles a row a cell and task; only keys in full cells are counted one by one.
    """
    cell = F.pmod(F.col("key"), F.lit(max(4096, 8 * total // hot))).alias("cell")
    full = cut(rows.groupBy(cell).count().where(F.col("count") > hot).select("cell"))
    if full.isEmpty():
        return None
    big = cut(rows.withColumn("cell", cell).join(full, "cell", "left_semi").groupBy("key").count().where(F.col("count") > hot))
    n_big = big.count()
    if not n_big:
        return None
    small = lambda df: F.broadcast(df) if n_big <= BROADCAST_IDS // 10 else df
    mine = rows.join(small(big), "key")
    votes = mine.groupBy("key", "count").agg(*[F.sum(F.expr(b)).alias(f"v{k}") for k, b in enumerate(_bits("hi", "lo"))])
    word = lambda w: " | ".join(f"if(2 * v{64 * w + k} > count, 1L << {k}, 0L)" for k in range(64))
    middle = cut(votes.selectExpr("key", f"{word(0)} as mhi", f"{word(1)} as mlo"))
    pivots = mine.join(small(middle), "key").groupBy("key").agg(F.min_by(F.struct("node", "hi", "lo"), F.struct(F.expr("bit_count(hi ^ mhi) + bit_count(lo ^ mlo)"), "node")).alias("p"))
    pivots = cut(pivots.selectExpr("key", "p.node as pivot", "p.hi as phi", "p.lo as plo"))
    near = mine.join(small(pivots), "key").withColumn("core", F.expr(f"bit_count(hi ^ phi) + bit_count(lo ^ plo) <= {most}"))
    slices = cut(near.groupBy("key").agg(F.ceil(F.count_if("core") / hot).cast("int").alias("cores"), F.ceil(F.count_if(~F.col("core")) / hot).cast("int").alias("others")))
    at = "cast(pmod(xxhash64(node), if(core, cores, others)) as int)"
    each = lambda n, i, j, role: f"transform(sequence(0, {n} - 1), x -> struct({i} as i, {j} as j, {role} as role))"
    # A slice of the others meets itself, the rest of them, and each slice of the pivot's neighbours.
    meets = f"if(core, {each('others', at, 'x', CORE)}, concat({each('others', f'least(x, {at})', f'greatest(x, {at})', SLICE)}, {each('cores', 'x', at, OTHER)}))"
    dealt = near.join(small(slices.where("others > 0")), "key").withColumn("m", F.explode(F.expr(meets)))
    dealt = dealt.select("node", "hi", "lo", F.xxhash64("key", "m.i", "m.j", F.col("m.role") == SLICE).alias("key"), F.col("m.role").cast("byte").alias("role"))
    return small(big.select("key")), near.where("core and node <> pivot").select(F.col("node").alias("src"), F.col("pivot").alias("dst")), dealt


def near_edges(nodes: DataFrame, *, most: int = MOST, recall: float = RECALL, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """Edges ``src``, ``dst`` between the ``node`` ids of distinct fingerprints (``node``, ``hi``, ``lo``); what is near is connected by them."""
    n = nodes.count()
    tables, sample = plan(n, most, recall, bucket)
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("hi").bitwiseAND(F.lit(a)), F.col("lo").bitwiseAND(F.lit(b))) for t, (a, b) in enumerate(samples(tables, sample))])
    rows = nodes.select("node", "hi", "lo", F.explode(keys).alias("key"))
    whole = rows.withColumn("role", F.lit(WHOLE).cast("byte"))
    crowded = _crowded(rows, n * tables, most, hot)
    if crowded:
        whole = whole.join(crowded[0], "key", "left_anti").select("node", "hi", "lo", "key", "role").unionByName(crowded[2])
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * tables // TASK_ROWS))
    edges = whole.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_linker(most, hot), "src bigint, dst bigint")
    return (edges.unionByName(crowded[1]) if crowded else edges).distinct()


def _grouped(fp: DataFrame, **how: int) -> DataFrame:
    """``id`` and ``group_id`` of every non-null id of ``fp`` with a fingerprint; repeated ids may repeat."""
    nodes = cut(fp.where("id is not null and hi is not null").groupBy("hi", "lo").agg(F.min("id").alias("node")))
    parts = connected_components(near_edges(nodes, **how))
    return (
        fp.where("id is not null and hi is not null").join(nodes, ["hi", "lo"])
        .join(parts, "node", "left")
        .select("id", F.coalesce("component", "node").alias("group_id"))
    )


def near_duplicates(docs: DataFrame, **how: int) -> DataFrame:
    """``doc_id``, ``group_id`` (the least id of the group), ``n_links`` (the other ids that it is linked to, directly or through others) and ``keep`` for every distinct id of ``docs``.

    One document of each group is kept, the one with the least id. Texts of any length are read whole. A text that is null, empty or without
    any word is in no group but its own and is kept. A repeated id is one document, grouped by the least
    of its groups. Null ids have no result. Other columns play no part. An empty table gives no rows.
    """
    fp = cut(fingerprint_table(docs))
    grouped = _grouped(fp, **how).unionByName(fp.where("id is not null and hi is null").select("id", F.col("id").alias("group_id")))
    one = cut(grouped.groupBy(F.col("id").alias("doc_id")).agg(F.min("group_id").alias("group_id")))
    # Most documents are alone; the sizes of the others' groups are few, and a group of any size is one row of them.
    sizes = cut(one.where("doc_id <> group_id").groupBy("group_id").agg(F.count("*").alias("n_links")))
    few = sizes.count() <= BROADCAST_IDS
    joined = one.join(F.broadcast(sizes) if few else sizes, "group_id", "left")
    return joined.select("doc_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.expr("doc_id = group_id").alias("keep"))


def drop_near_duplicates(docs: DataFrame, **how: int) -> DataFrame:
    """``docs`` with one document of each group of near copies, all columns as they were.

    The rules are those of :func:`near_duplicates`. Of the rows of a repeated id that stays, the one with
    the least text stays. Rows with a null id stay, as they can't be told apart.
    """
    fp = cut(fingerprint_table(docs))
    grouped = _grouped(fp, **how).groupBy("id").agg(F.min("group_id").alias("group_id"))
    key, drop, place = (free_name(docs, n) for n in ("__confluo_id", "__confluo_gone", "__confluo_n"))
    gone = grouped.where("id <> group_id").select(F.col("id").alias(key))
    again = fp.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias(key))
    marks = cut(gone.withColumn(drop, F.lit(True)).unionByName(again.withColumn(drop, F.lit(False))))
    marks = marks.groupBy(key).agg(F.max(drop).alias(drop), F.count("*").alias(place))
    n_gone, n_again = marks.agg(F.count_if(F.expr(drop)), F.count_if(F.expr(f"not {drop}"))).first()

    def small(df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df) if n <= BROADCAST_IDS else df

    on = docs["doc_id"] == F.col(key)
    out = docs.join(small(marks.select(key), n_gone + n_again), on, "left_anti")
    if n_again:
        first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
        kept = docs.join(small(marks.where(f"not {drop}").select(key), n_again), on, "left_semi")
        out = out.unionByName(kept.withColumn(place, F.row_number().over(first)).where(f"{place} = 1").drop(place))
    return out
