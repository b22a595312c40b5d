"""Trenches with the same reach share their pairs, also where a network is odd."""

import random

from confluo.operators import graph

ROW = "trench_id long, upstream_node long, downstream_node long, distance double, estuary_distance double"


def _some(spark, odd):
    rng, rows = random.Random(11), []
    for p in range(4, 120):
        rows.append((p, p, p // 4, float(rng.randrange(1, 30)), None))
    df = graph.accumulated_distance(spark.createDataFrame(rows, ROW))
    rows = [tuple(r[c] for c in ("trench_id", "upstream_node", "downstream_node", "distance", "estuary_distance")) for r in df.collect()]
    if odd:
        rows += [(200, 50, 50, 1.0, 3.0), (201, None, 5, 1.0, 3.0), (202, 51, 4, 1.0, 7.0), (60, 60, 7, 2.0, 9.0), (203, 90, 6, 1.0, None), (204, 1, 100, 5.0, 400.0)]
    return spark.createDataFrame(rows, ROW)


def _pairs(df):
    return sorted((r.target, r.source, r.distance) for r in df.select("target", "source", "distance").collect())


def test_representatives_have_the_same_pairs(spark):
    for odd in (False, True):
        t = _some(spark, odd)
        members = graph.same_reach(t)
        few = members.select(members.representative.alias("trench_id")).distinct()
        pairs = graph.upstream_pairs(t, targets=few).withColumnRenamed("target", "representative").join(members, "representative").withColumnRenamed("trench_id", "target")
        assert [x for x in _pairs(pairs) if x[2] is not None] == [x for x in _pairs(graph.upstream_pairs(t)) if x[2] is not None]
        assert odd or few.count() * 3 < t.count()
