"""Networks on fixtures that can be checked by hand."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from confluo.operators import graph, network
from confluo.operators.components import connected_components

SCHEMA = "trench_id long, upstream_node long, downstream_node long, distance double, estuary_distance double, system_id long"


def chain(spark, n):
    return spark.createDataFrame([(k, k + 1) for k in range(n - 1)], "src long, dst long")


def pairs_of(df):
    return {(r.src, r.dst): r.hops for r in df.collect()}


def test_chain_of_eight(spark):
    assert len(pairs_of(graph.closure(chain(spark, 8)))) == 28
    limited = pairs_of(graph.closure(chain(spark, 8), max_hops=5))
    assert len(limited) == 25 and max(limited.values()) == 5


@pytest.mark.parametrize("seed, edges", [(1, 60), (2, 45), (3, 120)])
def test_closure_equals_a_walk_from_each_node(spark, seed, edges):
    """Random digraphs with cycles, loops, repeated edges and a tail of 11 hops, against breadth-first walks."""
    draw = random.Random(seed)
    given_edges = [(draw.randrange(40), draw.randrange(40)) for _ in range(edges)] + [(k, k + 1) for k in range(39, 50)]
    given_edges += given_edges[:5]
    below = {}
    for a, b in given_edges:
        below.setdefault(a, set()).add(b)
    want = {}
    for start in below:
        seen, level, hops = {start}, {start}, 0
        while level := {b for a in level for b in below.get(a, ())} - seen:
            hops += 1
            seen |= level
            want |= {(start, b): hops for b in level}
    got = graph.closure(spark.createDataFrame(given_edges, "src long, dst long")).collect()
    assert len(got) == len(want) and {(r.src, r.dst): r.hops for r in got} == want


def test_diamond_and_cycle(spark):
    diamond = spark.createDataFrame([(1, 2), (2, 4), (1, 3), (3, 4)], "src long, dst long")
    assert pairs_of(graph.closure(diamond)) == {(1, 2): 1, (1, 3): 1, (2, 4): 1, (3, 4): 1, (1, 4): 2}
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    assert len(pairs_of(graph.closure(cycle))) == 6


def confluence(spark):
    return spark.createDataFrame([(1, 1, 3, 5.0, 10.0, 0), (2, 2, 3, 7.0, 10.0, 0), (3, 3, 4, 10.0, 0.0, 0)], SCHEMA)


def upstream(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.target, {})[r.source] = r.distance
    return out


def test_siblings(spark):
    both = upstream(graph.upstream_pairs(confluence(spark)))
    assert both == {1: {1: 0.0, 2: 0.0}, 2: {1: 0.0, 2: 0.0}, 3: {1: 10.0, 2: 10.0, 3: 0.0}}
    strict = upstream(graph.upstream_pairs(confluence(spark), include_siblings=False))
    assert strict == {1: {1: 0.0}, 2: {2: 0.0}, 3: {1: 10.0, 2: 10.0, 3: 0.0}}


def test_network_class(spark, tmp_path):
    n = graph.Network(confluence(spark).drop("system_id")).compute_subsystems().compute_indexes()
    assert {r.system_id for r in n.trenches.collect()} == {0} and n.trenches.columns.count("trench_index") == 1
    assert [(r.trench_id, r.upstream_distance) for r in n.get_upstream_trenches(3).collect()] == [(3, 0.0), (1, 10.0), (2, 10.0)]
    with pytest.raises(KeyError):
        n.get_upstream_trenches(99)
    assert graph.check_index(n.trenches).isEmpty() and not graph.check_index(n.trenches.withColumn("trench_index", F.col("trench_index") * 2)).isEmpty()
    assert [r.node for r in n.get_system_node_ids(0).collect()] == [1, 2, 3, 4] and [r.trench_id for r in n.arrange_by_systems().collect()] == [1, 2, 3]
    areas = spark.createDataFrame([(1, 2.0), (2, 3.0)], "trench_id long, drainage_area double")
    marked = graph.Network(n.trenches, areas).annotate_areas(inside=areas.where("trench_id = 1"))
    marked.save(str(tmp_path))
    again = graph.Network.load(spark, str(tmp_path))
    assert {r.trench_id: r.within_brazil for r in again.areas.collect()} == {1: True, 2: False} and again.trenches.count() == 3


def test_two_systems_and_node_kinds(spark):
    t = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 10, 11)], "trench_id long, upstream_node long, downstream_node long")
    s = graph.number_systems(graph.systems(t))
    assert {r.trench_id: r.system_id for r in s.collect()} == {1: 0, 2: 0, 3: 1}
    assert {r.node: r.kind for r in graph.node_types(t).collect()} == {1: "source", 2: "link", 3: "estuary", 10: "source", 11: "estuary"}


def test_accumulated_distance(spark):
    t = confluence(spark)
    assert {r.trench_id: r.estuary_distance for r in graph.accumulated_distance(t).collect()} == {1: 10.0, 2: 10.0, 3: 0.0}
    assert {r.node: r.node_distance for r in graph.node_distances(t).collect()} == {1: 15.0, 2: 17.0, 3: 10.0, 4: 0.0}


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=16))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(15):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_empty_bucket_and_shares(spark):
    targets = spark.createDataFrame([(3, 2000), (3, 2001)], "trench_id long, year int")
    cover = spark.createDataFrame([(1, 2000, 8.0, 2.0), (2, 2000, 4.0, 4.0), (3, 2000, 1.0, 0.0), (3, 2000, 1.0, 1.0)], "trench_id long, year int, land_cover_total double, c0 double")
    rows = {r.year: r for r in network.upstream_by_bucket(targets, graph.upstream_pairs(confluence(spark)), cover, ["c0"]).collect()}
    r = rows[2000]
    assert (r["lc_0_10km_tot"], r["lc_0_10km_n"], r["lc_0_10km_c0_cnt"]) == (14.0, 3, 7.0) and r["lc_0_10km_c0_shr"] == 0.5
    assert rows[2001]["lc_0_10km_tot"] == 0 and rows[2001]["lc_0_10km_c0_shr"] is None and r["lc_10_50km_n"] == 0


def test_matches_and_assembly(spark):
    pairs = graph.upstream_pairs(confluence(spark))
    where = spark.createDataFrame([("w", 3), ("f", 1), ("g", 3)], "station_code string, trench_id long")
    m = {(r.wq_station_code, r.streamflow_station_code): r.streamflow_weight for r in network.match_stations(pairs, where.where("station_code = 'w'"), where.where("station_code <> 'w'"), 20.0).collect()}
    assert m == {("w", "f"): 0.5, ("w", "g"): 1.0}
    quality = spark.createDataFrame([("w", "2020-01-02", 7.0), ("w", "2020-01-09", 8.0)], "station_code string, date string, ph double")
    flow = spark.createDataFrame([("f", "2020-01-02", 3.0), ("g", "2020-01-02", None), ("g", "2020-01-01", 9.0)], "station_code string, date string, discharge double").withColumn("date", F.to_date("date"))
    out = {str(r.date): r for r in network.assemble_sensor_data(quality, flow, where, pairs, 20.0).collect()}
    a = out["2020-01-02"]
    assert (a.streamflow_discharge_day, a.streamflow_match_count, a.streamflow_nonnull_day_count, a.streamflow_total_weight, a.streamflow_nearest_distance) == (3.0, 2, 1, 1.5, 0.0)
    assert a.streamflow_discharge_mean_7d == pytest.approx((3 * 0.5 + 9) / 1.5) and out["2020-01-09"].streamflow_match_count == 0 and a.trench_id == 3


def test_weights_add_up(spark):
    d = spark.createDataFrame([("a", "b", 10.0), ("a", "c", 30.0), ("a", "d", 900.0), ("b", "c", 500.0)], "target_unit string, source_unit string, distance double")
    for kind in ("linear", "exponential", "inverse"):
        w = network.upstream_weights(d, 100.0, kind).collect()
        assert {r.source_unit for r in w} == {"b", "c"} and sum(r.weight for r in w) == pytest.approx(1)
    panel = spark.createDataFrame([("b", 1, 4.0), ("c", 1, None)], "id string, year int, v double")
    assert [(r.id, r.v_upstream) for r in network.upstream_mean(network.upstream_weights(d, 100.0), panel, "v", unit="id", period="year").collect()] == [("a", 4.0)]
