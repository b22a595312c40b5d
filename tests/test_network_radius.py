"""Pairs within a radius are those of the closure, which isn't made where the network allows it."""

from confluo.operators import graph
from test_network_classes import _pairs, _some


def test_pairs_within_a_radius(spark, monkeypatch):
    want = {}
    for odd in (False, True):
        t = _some(spark, odd)
        want[odd] = [x for x in _pairs(graph.upstream_pairs(t)) if x[2] is not None and abs(x[2]) < 20]
        some, ones = (t.where(w).select("trench_id") for w in ("trench_id % 3 > 0", "trench_id % 7 = 1"))
        assert odd is False or _pairs(graph.pairs_within(t, 20.0)) == want[odd]
        assert _pairs(graph.pairs_within(t, 20.0, some, ones)) == [x for x in want[odd] if x[0] % 3 and x[1] % 3 and 1 in (x[0] % 7, x[1] % 7)]
    monkeypatch.setattr(graph, "closure", None)
    assert _pairs(graph.pairs_within(_some(spark, False), 20.0)) == want[False] and want[False]
