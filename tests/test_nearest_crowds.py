"""The nearest point where cells of the first width are full, and where many points share a place."""

import math
import random

from confluo.operators import matching

N = 1500


def test_full_cells_are_split(spark, monkeypatch):
    rng = random.Random(8)
    a = [(k, rng.uniform(0, 99), float(rng.randrange(3) * 40)) for k in range(N)]
    b = [(k, rng.uniform(0, 99), float(rng.randrange(3) * 40)) for k in range(N)] + [(N + k, 50.0, 40.0) for k in range(N)]
    left, right = (spark.createDataFrame(rows, f"{key} long, x double, y double") for key, rows in (("a", a), ("b", b)))
    met, join = [], type(left).join

    def counted(x, y, on=None, how=None):
        out = join(x, y, on, how)
        met.append(out.count() if on == ["__cx", "__cy"] else 0)
        return out

    monkeypatch.setattr(type(left), "join", counted)
    out = matching.nearest_point(left, right, left_id="a", right_id="b", step=200.0)
    monkeypatch.undo()
    got = {r.left_id: r.right_id for r in out.collect()}
    assert got == {i: min((math.hypot(x - u, y - v), j) for j, u, v in b)[1] for i, x, y in a}
    assert 0 < sum(met) < 100 * N
