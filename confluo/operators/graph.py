"""Directed drainage networks: systems, closures, estuary distances and what lies upstream.

A network is a table of trenches, each an edge ``upstream_node`` -> ``downstream_node`` with its own ``distance`` and the
``estuary_distance`` of its lower end. Nothing here is collected; iterations are cut by checkpoints in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from confluo.operators.components import connected_components
from confluo.session import cut, free_name

#: A closure is refused beyond this many rounds; each round doubles the hops that it covers.
MOST_ROUNDS = 40


def edges_of(trenches: DataFrame) -> DataFrame:
    """Distinct edges ``src``, ``dst``."""
    return trenches.select(F.col("upstream_node").alias("src"), F.col("downstream_node").alias("dst")).dropna().distinct()


def node_ids(trenches: DataFrame) -> DataFrame:
    return trenches.select(F.explode(F.array("upstream_node", "downstream_node")).alias("node")).dropna().distinct()


def systems(trenches: DataFrame) -> DataFrame:
    """Trenches with ``system_id``: the least node of the component that they are in."""
    parts = connected_components(trenches, "upstream_node", "downstream_node").select(F.col("node").alias("upstream_node"), F.col("component").alias("system_id"))
    return trenches.drop("system_id").join(parts, "upstream_node", "left")


def number_systems(trenches: DataFrame) -> DataFrame:
    """``system_id`` replaced by its place, from 0, in the order of the systems' least nodes. The systems are sorted in ranges, which are counted, so no task ranks them all."""
    rank = free_name(trenches, "__confluo_rank")
    each = cut(trenches.select("system_id").distinct().repartitionByRange("system_id").withColumn("__p", F.spark_partition_id()))
    before = each.groupBy("__p").agg(F.count("*").alias("__c")).withColumn("__c", F.sum("__c").over(Window.orderBy("__p")) - F.col("__c"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy("system_id")) - 1
    ranked = each.withColumn("__k", within).join(F.broadcast(before), "__p").select(F.col("system_id").alias("__s"), (F.col("__k") + F.col("__c")).alias(rank))
    joined = trenches.join(ranked, F.col("system_id").eqNullSafe(F.col("__s")), "left")
    return joined.select(*[F.col(rank).alias(c) if c == "system_id" else trenches[c] for c in trenches.columns])


def closure(edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``src``, ``dst`` and ``hops`` (the fewest) of every pair with a path from ``src`` to ``dst`` of one hop or more.

    Without a limit the paths double in length each round, so a chain of n nodes takes log2(n) rounds. With ``max_hops``
    they grow by a hop a round, and longer ones are left out. Cycles end when no pair is new.
    """
    e = edges.select("src", "dst").dropna().where("src <> dst").distinct().withColumn("hops", F.lit(1).cast("long"))
    if max_hops is not None:
        frontier = found = cut(e)
        for k in range(2, max_hops + 1):
            step = frontier.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).where("src <> dst").distinct()
            frontier = cut(step.join(found, ["src", "dst"], "left_anti").withColumn("hops", F.lit(k).cast("long")))
            if frontier.isEmpty():
                break
            found = cut(found.unionByName(frontier))
        return found
    # Of a fewest-hops path of more than `most` hops, the first `most` are a pair with that many hops, so only such pairs go on,
    # no pair gets closer later, and each round writes its new pairs alone.
    rounds, most = [cut(e)], 1
    for _ in range(MOST_ROUNDS):
        # The tables of the rounds are used under new names, as a union of checkpoints can't be joined to one of them.
        onward = reduce(DataFrame.unionByName, [r.select(F.col("src").alias("via"), F.col("dst").alias("end"), F.col("hops").alias("more")) for r in rounds])
        known = reduce(DataFrame.unionByName, [r.select(F.col("src").alias("a"), F.col("dst").alias("b")) for r in rounds])
        longest = rounds[-1].where(F.col("hops") == most).select("src", F.col("dst").alias("via"))
        longer = longest.join(onward, "via").where("src <> end").groupBy("src", F.col("end").alias("dst")).agg((F.min("more") + most).alias("hops"))
        new = cut(longer.join(known, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")), "left_anti"))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, [r.select(*[F.col(c).alias(c) for c in ("src", "dst", "hops")]) for r in rounds])
        rounds.append(new)
        most *= 2
    raise ValueError(f"the closure didn't end after {MOST_ROUNDS} rounds")


def node_distances(trenches: DataFrame) -> DataFrame:
    """``node`` and its distance from the estuary: the given one at lower ends (of the last trench there), else the lower end's plus the length."""
    down = trenches.groupBy(F.col("downstream_node").alias("node")).agg(F.max_by("estuary_distance", "trench_id").alias("__d"))
    up = trenches.groupBy(F.col("upstream_node").alias("node")).agg(F.min_by(F.col("estuary_distance") + F.col("distance"), "trench_id").alias("__u"))
    return down.join(up, "node", "full").select("node", F.coalesce("__d", "__u").alias("node_distance"))


def upstream_pairs(trenches: DataFrame, *, include_siblings: bool = True, max_hops: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """``target``, ``source``, ``distance`` and, where trenches have one, ``system_id`` of every trench ``source`` upstream of a trench ``target``, itself at 0.

    A trench is upstream if its upper node reaches the target's lower node. That takes in trenches that only join at the target's
    lower end, and what is above them; without ``include_siblings`` it must reach the target's upper node. The distance is that of the
    lower ends from the estuary. ``targets`` (``trench_id``) limits the pairs, and, of trenches with a ``system_id``, the closure to the targets' systems.
    """
    system = ["system_id"] if "system_id" in trenches.columns else []
    if targets is not None and system:
        asked = trenches.join(targets.select("trench_id").distinct(), "trench_id", "left_semi").select(F.col("system_id").alias("__s")).distinct()
        trenches = cut(trenches.join(asked, F.col("system_id").eqNullSafe(F.col("__s")), "left_semi"))
    t = trenches.select("trench_id", "upstream_node", "downstream_node", *system, "estuary_distance")
    wanted = t if targets is None else t.join(targets.select("trench_id").distinct(), "trench_id", "left_semi")
    low = "downstream_node" if include_siblings else "upstream_node"
    a = wanted.select(F.col("trench_id").alias("target"), F.col(low).alias("dst"), *system, F.col("estuary_distance").alias("__a"))
    b = t.select(F.col("trench_id").alias("source"), F.col("upstream_node" if include_siblings else "downstream_node").alias("src"), F.col("estuary_distance").alias("__b"))
    reach = closure(edges_of(trenches), max_hops).select("src", "dst")
    if not include_siblings:
        # The source's lower node may be the target's upper node itself.
        reach = reach.unionByName(node_ids(trenches).select(F.col("node").alias("src"), F.col("node").alias("dst")))
    pairs = a.join(reach, "dst").join(b, "src").where("target <> source").select("target", "source", *system, (F.col("__b") - F.col("__a")).alias("distance"))
    itself = a.select("target", F.col("target").alias("source"), *system, F.lit(0.0).alias("distance"))
    return pairs.unionByName(itself).groupBy("target", "source").agg(*[F.min(c).alias(c) for c in system], F.min("distance").alias("distance"))


def pairs_within(trenches: DataFrame, radius: float, among: DataFrame | None = None, one_of: DataFrame | None = None) -> DataFrame:
    """The ``target``, ``source`` and ``distance`` of :func:`upstream_pairs` that are less than ``radius`` apart.

    Each trench walks down node by node as long as it is within the radius, so the closure isn't made. ``among`` (``trench_id``) has those that pairs are wanted of,
    ``one_of`` those of which a pair has one at least. Where distances don't fall on the way down, or differ at a node, and where ways have over ``MOST_ROUNDS`` nodes, all pairs are made.
    """
    t = cut(trenches.select("trench_id", "upstream_node", "downstream_node", F.col("estuary_distance").cast("double").alias("at")))
    chosen = lambda d, only, c: d if only is None else d.join(only.select(F.col("trench_id").alias(c)).distinct(), c, "left_semi")
    flagged = t.withColumn("one", F.lit(True)) if one_of is None else t.join(one_of.select("trench_id", F.lit(True).alias("one")).distinct(), "trench_id", "left").fillna(False, ["one"])
    flagged = cut(chosen(flagged, among, "trench_id"))
    at_node = t.groupBy(F.col("downstream_node").alias("node")).agg(F.min("at").alias("least"), F.max("at").alias("most"))
    below = t.select(F.col("upstream_node").alias("node"), F.col("at").alias("next_at"))
    odd = [
        t.where("trench_id is null or upstream_node is null or downstream_node is null or upstream_node = downstream_node or at is null or isnan(at) or abs(at) = double('infinity')"),
        at_node.where("least <> most"), at_node.join(below, "node").where("next_at > least"),
    ]
    found: list[DataFrame] = []
    if all(o.isEmpty() for o in odd):
        steps = t.select(F.col("upstream_node").alias("node"), F.col("downstream_node").alias("next"), F.col("at").alias("next_at")).distinct()
        found.append(flagged.select(F.col("trench_id").alias("source"), F.col("upstream_node").alias("top"), F.col("downstream_node").alias("node"), F.col("at").alias("start"), F.col("at"), "one").distinct())
        for _ in range(MOST_ROUNDS):
            onward = found[-1].join(steps, "node").where((F.col("start") - F.col("next_at") < radius) & (F.col("next") != F.col("top")))
            onward = onward.select("source", "top", F.col("next").alias("node"), "start", F.col("next_at").alias("at"), "one").distinct()
            known = reduce(DataFrame.unionByName, [f.select(F.col("source").alias("s"), F.col("top").alias("u"), F.col("node").alias("n"), F.col("start").alias("d")) for f in found])
            new = cut(onward.join(known, (F.col("source") == F.col("s")) & (F.col("top") == F.col("u")) & (F.col("node") == F.col("n")) & (F.col("start") == F.col("d")), "left_anti"))
            if new.isEmpty():
                break
            found.append(new)
        else:
            found = []
    if not found:
        whole = chosen(chosen(upstream_pairs(trenches).where(F.abs("distance") < radius), among, "target"), among, "source").select("target", "source", "distance")
        if one_of is None:
            return whole
        ones = one_of.select(F.col("trench_id").alias("__t")).distinct()
        kept = whole.join(ones, F.col("target") == F.col("__t"), "left_semi").unionByName(whole.join(ones, F.col("source") == F.col("__t"), "left_semi"))
        return kept.distinct()
    reached = reduce(DataFrame.unionByName, [f.select(*[F.col(c).alias(c) for c in ("source", "node", "start", "at", "one")]) for f in found])
    ends = flagged.select(F.col("trench_id").alias("target"), F.col("downstream_node").alias("node"), F.col("one").alias("__one"))
    pairs = reached.join(ends, "node").where((F.col("one") | F.col("__one")) & (F.col("target") != F.col("source"))).select("target", "source", (F.col("start") - F.col("at")).alias("distance"))
    itself = flagged.where("one").select(F.col("trench_id").alias("target"), F.col("trench_id").alias("source"), F.lit(0.0).alias("distance")).where(F.lit(0.0) < radius)
    return pairs.where(F.abs("distance") < radius).unionByName(itself).groupBy("target", "source").agg(F.min("distance").alias("distance"))


def same_reach(trenches: DataFrame) -> DataFrame:
    """``trench_id`` and ``representative``: the least of the trenches that have the same trenches upstream, at the same distances, in :func:`upstream_pairs`.

    Those end in one node at one distance from the estuary, and each counts among what is upstream of the others at 0, as it does of itself. A trench that ends where
    it begins, lacks a node or a distance or has several rows represents itself.
    """
    ends = F.col("estuary_distance")
    plain = (F.col("upstream_node") != F.col("downstream_node")) & ends.isNotNull() & ~F.isnan(ends) & (F.count("*").over(Window.partitionBy("trench_id")) == 1)
    system = ["system_id"] if "system_id" in trenches.columns else []
    alone = trenches.withColumn("__own", F.when(~F.coalesce(plain, F.lit(False)), F.col("trench_id")))
    least = F.min("trench_id").over(Window.partitionBy("downstream_node", "estuary_distance", "__own", *system))
    return alone.select("trench_id", F.coalesce("__own", least).alias("representative")).distinct()


def index_trenches(trenches: DataFrame) -> DataFrame:
    """``trench_index`` from 0 in each system, by distance from the estuary downwards and then by id."""
    w = Window.partitionBy("system_id").orderBy(F.col("estuary_distance").desc_nulls_last(), "trench_id")
    return trenches.withColumn("trench_index", (F.row_number().over(w) - 1).cast("long"))


def check_index(trenches: DataFrame, index: str = "trench_index") -> DataFrame:
    """Systems whose indexes aren't 0 to n-1, each once."""
    n = trenches.groupBy("system_id").agg(F.count("*").alias("n"), F.countDistinct(index).alias("distinct"), F.min(index).alias("least"), F.max(index).alias("most"))
    return n.where("least <> 0 or most + 1 <> n or distinct <> n or least is null")


def node_types(trenches: DataFrame) -> DataFrame:
    """``node`` with its numbers of trenches in and out, and whether it is a ``source``, ``estuary``, ``confluence`` or mere ``link``."""
    e = edges_of(trenches)
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    n = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return n.withColumn("kind", F.when(F.col("n_in") == 0, "source").when(F.col("n_out") == 0, "estuary").when(F.col("n_in") > 1, "confluence").otherwise("link"))


def point_types(trenches: DataFrame, border: DataFrame) -> DataFrame:
    """``node`` and its ``type``: ``border`` (an end that is in ``border``, a table of nodes), ``source``, ``estuary`` (any other end), ``network`` (one in, one out) or ``confluence``."""
    n = node_types(trenches).join(border.select("node").distinct().withColumn("__b", F.lit(True)), "node", "left")
    kind = F.when(F.col("__b") & (F.col("n_out") == 0), "border").when(F.col("n_in") == 0, "source").when(F.col("n_out") == 0, "estuary").when((F.col("n_in") == 1) & (F.col("n_out") == 1), "network").otherwise("confluence")
    return n.select("node", kind.alias("type"))


def edge_reachability(trenches: DataFrame) -> DataFrame:
    """``edge``, ``descendant`` and ``distance`` of each trench and those below it, itself at 0: how much nearer to the estuary the descendant's lower end is."""
    t = trenches.select("trench_id", "upstream_node", "estuary_distance")
    a = t.select(F.col("trench_id").alias("edge"), F.col("upstream_node").alias("src"), F.col("estuary_distance").alias("__a"))
    b = t.select(F.col("trench_id").alias("descendant"), F.col("upstream_node").alias("dst"), F.col("estuary_distance").alias("__b"))
    below = a.join(closure(edges_of(trenches)).select("src", "dst"), "src").join(b, "dst").where("edge <> descendant").select("edge", "descendant", (F.col("__a") - F.col("__b")).alias("distance"))
    return below.unionByName(a.select("edge", F.col("edge").alias("descendant"), F.lit(0.0).alias("distance")))


def reachable_sets(edges: DataFrame) -> DataFrame:
    """``node`` and the sorted list of nodes that it reaches."""
    return closure(edges).groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("reaches"))


def accumulated_distance(trenches: DataFrame) -> DataFrame:
    """Distance of each trench's lower end from the estuary, added up along the way down (``estuary_distance``).

    Every trench looks below itself; the way doubles each round. Of several ways down the trench takes the one to the least trench id.
    """
    below = trenches.select(F.col("upstream_node").alias("downstream_node"), F.col("trench_id").alias("b"), F.col("distance").alias("bd"))
    first = trenches.join(below, "downstream_node", "left").groupBy("trench_id").agg(F.min_by(F.struct("b", "bd"), "b").alias("__n"))
    now = cut(first.select("trench_id", F.col("__n.b").alias("next"), F.coalesce("__n.bd", F.lit(0.0)).cast("double").alias("total")))
    for _ in range(MOST_ROUNDS):
        if now.where("next is not null").isEmpty():
            break
        onward = now.select(F.col("trench_id").alias("next"), F.col("next").alias("then"), F.col("total").alias("more"))
        now = cut(now.join(onward, "next", "left").select("trench_id", F.col("then").alias("next"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")))
    return trenches.drop("estuary_distance").join(now.select("trench_id", F.col("total").alias("estuary_distance")), "trench_id")


class Network:
    """A network as tables; each method gives a table or a new network."""

    def __init__(self, trenches: DataFrame, areas: DataFrame | None = None):
        self.trenches, self.areas = trenches, areas

    def compute_subsystems(self) -> Network:
        return Network(number_systems(systems(self.trenches)), self.areas)

    def compute_indexes(self) -> Network:
        return Network(index_trenches(self.trenches), self.areas)

    def arrange_by_systems(self) -> DataFrame:
        return self.trenches.orderBy("system_id", F.col("estuary_distance").desc(), "trench_id")

    def get_upstream_trenches(self, trench_id: int, **how: object) -> DataFrame:
        """``trench_id``, ``upstream_distance`` and ``system_id`` of what is upstream; KeyError if the trench isn't there."""
        target = self.trenches.where(F.col("trench_id") == trench_id).select("trench_id")
        if target.isEmpty():
            raise KeyError(trench_id)
        pairs = upstream_pairs(self.trenches, targets=target, **how)
        return pairs.select(F.col("source").alias("trench_id"), F.col("distance").alias("upstream_distance"), "system_id").orderBy("upstream_distance", "trench_id")

    def get_system_trench_ids(self, system_id: int) -> DataFrame:
        return self.trenches.where(F.col("system_id") == system_id).select("trench_id").orderBy("trench_id")

    def get_system_node_ids(self, system_id: int) -> DataFrame:
        return node_ids(self.trenches.where(F.col("system_id") == system_id)).orderBy("node")

    def annotate_areas(self, within: str = "within_brazil", *, inside: DataFrame) -> Network:
        """Areas with a flag for those of ``inside`` (``trench_id``)."""
        if self.areas is None:
            raise ValueError("the network has no areas")
        marked = self.areas.drop(within).join(inside.select("trench_id").distinct().withColumn(within, F.lit(True)), "trench_id", "left")
        return Network(self.trenches, marked.fillna(False, [within]))

    def save(self, folder: str) -> None:
        self.trenches.write.mode("overwrite").parquet(f"{folder}/river_trenches.parquet")
        if self.areas is not None:
            self.areas.write.mode("overwrite").parquet(f"{folder}/drainage_areas.parquet")

    @staticmethod
    def load(spark, folder: str, with_areas: bool = True) -> Network:
        return Network(spark.read.parquet(f"{folder}/river_trenches.parquet"), spark.read.parquet(f"{folder}/drainage_areas.parquet") if with_areas else None)


def least_distance(pairs: list[DataFrame], keys: list[str]) -> DataFrame:
    """The least distance over several tables of pairs."""
    return reduce(DataFrame.unionByName, pairs).groupBy(*keys).agg(F.min("distance").alias("distance"))
