"""Blocks of wide boxes: the join copies each box a few times, however many blocks there are, and full cells are dealt out."""

import random

from confluo.operators import matching

NAMES, BOX = "id long, x0 double, y0 double, x1 double, y1 double", ("x0", "y0", "x1", "y1")


def _blocks(blocks, n):
    rng, rows = random.Random(6), []
    for k in range(blocks):
        for i in range(n):
            (x0, x1), (y0, y1) = sorted((rng.random(), rng.random())), sorted((rng.random(), rng.random()))
            rows.append((k * n + i, x0, k + y0, x1, k + y1))
    return rows


def test_few_copies_and_full_cells(spark):
    for blocks, n, most in ((1, 60, 50.0), (90, 6, 1e8), (90, 6, 20.0)):
        rows = _blocks(blocks, n)
        df = spark.createDataFrame(rows, NAMES)
        got = sorted(map(tuple, matching.box_join(df, df, BOX, left_id="id", right_id="id", most_pairs=most).collect()))
        assert got == sorted((p[0], q[0]) for p in rows for q in rows if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])


def test_rows_sent_to_the_join(spark, monkeypatch):
    """Each box of the right was sent to some 20 places: the cells of both axes, in 8 parts each."""
    df, sides = spark.createDataFrame(_blocks(90, 20), NAMES), []
    join = type(df).join
    monkeypatch.setattr(type(df), "join", lambda a, b, *how: (sides.append((a, b)), join(a, b, *how))[1])
    matching.box_join(df, df, BOX, left_id="id", right_id="id")
    assert all(x.count() <= 3 * 1800 for x in sides[-1])
