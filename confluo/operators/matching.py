"""Joins by distance and place, and who is still to be fetched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from confluo.session import cut


def radius_join(left: DataFrame, right: DataFrame, x: str, radius: float, *, left_id: str, right_id: str, y: str | None = None) -> DataFrame:
    """Pairs at most ``radius`` apart in ``x`` (and ``y``), with their distance.

    Rows meet by cells of the size of the radius, so the join is an equi-join that spreads over the cluster, not a product of the tables.
    """
    if radius <= 0:
        raise ValueError("the radius is over 0")
    axes = [x] + ([y] if y else [])
    keep = lambda df, i, side: df.select(F.col(i).alias(f"{side}_id"), *[F.col(a).cast("double").alias(f"__{side}{k}") for k, a in enumerate(axes)]).dropna()
    a, b = keep(left, left_id, "left"), keep(right, right_id, "right")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for k in range(len(axes)):
        a = a.withColumn(f"__c{k}", F.explode(F.transform(around, _plus(F.floor(F.col(f"__left{k}") / radius)))))
        b = b.withColumn(f"__c{k}", F.floor(F.col(f"__right{k}") / radius))
    square = sum(((F.col(f"__left{k}") - F.col(f"__right{k}")) ** 2 for k in range(len(axes))), F.lit(0.0))
    distance = F.abs(F.col("__left0") - F.col("__right0")) if not y else F.sqrt(square)
    return a.join(b, [f"__c{k}" for k in range(len(axes))]).select("left_id", "right_id", distance.alias("distance")).where(F.col("distance") <= radius)


def _plus(c: Column):
    return lambda d: c + d


def nearest_join(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, left_value: str, right_value: str, on: str) -> DataFrame:
    """For each ``left_id`` the ``right_id`` with the same ``on`` whose value is nearest, and their ``distance``; of equally near ones the least id.

    Both sides are put in one order of ``on`` and value, in ranges, and each value looks at the next of ``right`` on either side; no pairs of a key are made. Only values
    whose next two are at the same rounded distance, or whose next is infinitely far, are compared with all of their key.
    """
    value, there = F.col("__x"), lambda df, k, x: df.where(F.col(k).isNotNull() & F.col(x).isNotNull())
    a = there(left, on, left_value).select(F.col(left_id).alias("__l"), F.col(on).alias("__on"), F.col(left_value).alias("__x"))
    b = there(right, on, right_value).select(F.col(on).alias("__on"), F.col(right_value).alias("__x"), F.col(right_id).alias("__r"))
    both = a.select("__on", "__x", F.lit(False).alias("__is")).unionByName(b.withColumn("__is", F.lit(True)), allowMissingColumns=True)
    both = both.groupBy("__on", "__x").agg(F.min("__r").alias("__r"), F.bool_or("__is").alias("__is"))
    placed = cut(both.repartitionByRange("__on", "__x").withColumn("__p", F.spark_partition_id()))
    marked = placed
    for side, by in (("low", value.asc()), ("high", value.desc())):
        w = Window.partitionBy("__p", "__on").orderBy(by)
        beyond = F.last(F.when(F.col("__is"), value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = marked.withColumn("__b", beyond).withColumn(f"__{side}", F.last(F.when(F.col("__is"), F.struct("__x", "__r", "__b")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # What the ranges before and after a range end with; a range with one value of a key has what is beyond it from those too.
    ends = marked.groupBy("__p", "__on").agg(F.max(F.when(F.col("__is"), F.col("__low"))).alias("__low"), F.min(F.when(F.col("__is"), F.col("__high"))).alias("__high"))
    for side, by in (("low", F.asc("__p")), ("high", F.desc("__p"))):
        last = F.last(f"__{side}", ignorenulls=True).over(Window.partitionBy("__on").orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
        whole = F.when(F.col(f"__{side}").isNotNull(), F.struct(F.col(f"__{side}.__x"), F.col(f"__{side}.__r"), F.coalesce(f"__{side}.__b", "__o.__x").alias("__b")))
        ends = ends.withColumn("__o", last).withColumn(f"__{side}", whole).withColumn(f"__o{side}", last)
    seen = marked.join(ends.select("__p", "__on", "__olow", "__ohigh"), ["__p", "__on"]).where(F.col("__x").isNotNull())
    apart = lambda x: F.abs(value - x)
    for side in ("low", "high"):
        n = F.coalesce(f"__{side}", f"__o{side}")
        further = F.coalesce(n["__b"], F.when(F.col(f"__{side}").isNotNull(), F.col(f"__o{side}.__x")))
        near = F.struct(apart(n["__x"]).alias("distance"), n["__r"].alias("__r"), F.coalesce(apart(further) == apart(n["__x"]), F.lit(False)).alias("__even"))
        seen = seen.withColumn(f"__n{side}", F.when(n.isNotNull(), near))
    even = F.greatest(F.coalesce("__nlow.__even", F.lit(False)), F.coalesce("__nhigh.__even", F.lit(False)))
    best = cut(seen.select("__on", "__x", F.least("__nlow", "__nhigh").alias("__n"), even.alias("__even")).where("__n is not null").select("__on", "__x", "__n.distance", "__n.__r", "__even"))
    close = ~F.col("__even") & (F.col("distance") < float("inf"))
    rest = best.where(~close).select("__on", F.col("__x").alias("__lx"))
    if not rest.isEmpty():
        all_ = rest.join(placed.where("__is").select("__on", "__x", "__r"), "__on").groupBy("__on", F.col("__lx").alias("__x")).agg(F.min(F.struct(F.abs(F.col("__lx") - value).alias("distance"), "__r")).alias("__n"))
        best = best.where(close).drop("__even").unionByName(all_.select("__on", "__x", "__n.distance", "__n.__r"))
    # Ids that left has more than once take the nearest of all.
    found = a.join(best.select("__on", "__x", "distance", "__r"), ["__on", "__x"]).groupBy("__l").agg(F.min(F.struct("distance", "__r")).alias("__n"))
    return found.select(F.col("__l").alias(left_id), F.col("__n.__r").alias(right_id), F.col("__n.distance").alias("distance"))


def in_box(x: Column | str, y: Column | str, box: tuple[float | None, float | None, float | None, float | None]) -> Column:
    """Whether a point lies in (least x, least y, most x, most y). A bound that is None is open, one of 0 is a bound."""
    cx, cy = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    out = F.lit(True)
    for c, low, high in ((cx, box[0], box[2]), (cy, box[1], box[3])):
        out = out if low is None else out & (c >= low)
        out = out if high is None else out & (c <= high)
    return out


def boxes_intersect(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Whether boxes in columns (least x, least y, most x, most y) touch."""
    return (F.col(a[0]) <= F.col(b[2])) & (F.col(b[0]) <= F.col(a[2])) & (F.col(a[1]) <= F.col(b[3])) & (F.col(b[1]) <= F.col(a[3]))


def box_join(left: DataFrame, right: DataFrame, box: tuple[str, str, str, str], *, left_id: str, right_id: str, most_cells: int = 64, most_pairs: float = 1e8) -> DataFrame:
    """All pairs of boxes (least x, least y, most x, most y; finite) that touch, each once as ``left_id`` and ``right_id``. Boxes with a null bound touch none.

    Each box goes to every cell of a grid that it covers, and a pair is taken in the cell of its common lower corner alone. Cells are as wide as the mean box of
    both sides; an axis has ``most_cells`` or the square root of the number of boxes at most, and is left whole where the mean box covers a quarter of it. A cell
    of over ``most_pairs`` pairs is dealt out by both sides to a square of parts.
    """
    keep = lambda df, i, side: df.select(F.col(i).alias(f"{side}_id"), *[F.col(c).cast("double").alias(f"__{side}{k}") for k, c in enumerate(box)]).dropna(subset=[f"__{side}{k}" for k in range(4)])
    a, b = (d.where(F.col(f"__{s}0") <= F.col(f"__{s}2")).where(F.col(f"__{s}1") <= F.col(f"__{s}3")) for d, s in ((keep(left, left_id, "l"), "l"), (keep(right, right_id, "r"), "r")))
    a, b = cut(a), cut(b)
    both = a.select(*[F.col(f"__l{k}").alias(f"b{k}") for k in range(4)]).union(b.select(*[f"__r{k}" for k in range(4)]))
    size = both.agg(F.count("*").alias("n"), *[F.min(f"b{k}").alias(f"low{k}") for k in (0, 1)], *[(F.max(f"b{k + 2}") - F.min(f"b{k}")).alias(f"all{k}") for k in (0, 1)], *[F.avg(F.col(f"b{k + 2}") - F.col(f"b{k}")).alias(f"mean{k}") for k in (0, 1)]).first()
    if not size.n:
        return a.join(b, F.lit(False)).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))
    cells = max(most_cells, size.n**0.5)
    steps = [0.0 if size[f"mean{k}"] * 4 >= size[f"all{k}"] else max(size[f"mean{k}"], size[f"all{k}"] / cells) for k in (0, 1)]
    cell = lambda c, k: F.floor((c - F.lit(size[f"low{k}"])) / F.lit(steps[k])).cast("long") if steps[k] > 0 else F.lit(0).cast("long")

    def gridded(df: DataFrame, side: str) -> DataFrame:
        for k in (0, 1):
            if steps[k] > 0:
                df = df.withColumn(f"__c{k}", F.explode(F.sequence(cell(F.col(f"__{side}{k}"), k), cell(F.col(f"__{side}{k + 2}"), k))))
            else:
                df = df.withColumn(f"__c{k}", cell(F.lit(0), k))
        return df

    a, b, at = gridded(a, "l"), gridded(b, "r"), ["__c0", "__c1"]
    tally = a.select(*at, F.lit(1).alias("l"), F.lit(0).alias("r")).union(b.select(*at, F.lit(0), F.lit(1))).groupBy(*at).agg(F.sum("l").cast("double").alias("l"), F.sum("r").cast("double").alias("r"))
    # Few cells are so full: each has over 2 * sqrt(most_pairs) boxes.
    full = cut(tally.where(F.col("l") * F.col("r") > most_pairs).select(*at, F.ceil(F.sqrt(F.col("l") * F.col("r") / most_pairs)).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    own, every = (lambda i: F.pmod(F.hash(i), parts)), F.explode(F.sequence(F.lit(0), parts - 1))
    a = a.join(F.broadcast(full), at, "left").withColumn("__pl", own("l_id")).withColumn("__pr", every).drop("__parts")
    b = b.join(F.broadcast(full), at, "left").withColumn("__pr", own("r_id")).withColumn("__pl", every).drop("__parts")
    touch = boxes_intersect(tuple(f"__l{k}" for k in range(4)), tuple(f"__r{k}" for k in range(4)))
    for k in (0, 1):
        if steps[k] > 0:
            touch = touch & (cell(F.greatest(f"__l{k}", f"__r{k}"), k) == F.col(f"__c{k}"))
    return a.join(b, [*at, "__pl", "__pr"]).where(touch).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))


def in_polygon(x: Column | str, y: Column | str, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon, by the number of edges that a ray crosses."""
    cx, cy = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if ay != by:
            straddles = (cy < ay) != (cy < by)
            crossings = crossings + (straddles & (cx < (bx - ax) * (cy - ay) / (by - ay) + ax)).cast("int")
    return crossings % 2 == 1


#: Places that share a cell, on average over the places, before the cells of a search for the nearest are made smaller.
CROWD = 16


def _uncrowded(points: DataFrame, step: float, widest: float) -> float:
    """``step`` or the first quarter, sixteenth and so on of it with at most ``CROWD`` other places in the cell of the average place, as far as cells can be numbered."""
    while widest / step < 2.0**50:
        n = points.groupBy(F.floor(F.col("__rightx") / step), F.floor(F.col("__righty") / step)).agg(F.count("*").cast("double").alias("n"))
        if (n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0) <= CROWD:
            break
        step /= 4
    return step


def nearest_point(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, x: str = "x", y: str = "y", step: float) -> DataFrame:
    """For each point of ``left`` the nearest of ``right``, as ``left_id``, ``right_id`` and ``distance``; of equally near ones the least id.

    Points meet in the cell that they are in and the eight around it. What is found within a cell's width is the nearest; the rest is searched again in cells
    of twice the width, until all of ``right`` lies in nine cells. Points without coordinates have no result. ``step`` is the first width, or a fraction of it where
    cells of it are so full that a place of ``right`` shares its cell with more than ``CROWD`` on average; places with several points count once.
    """
    keep = lambda df, i, side: df.select(F.col(i).alias(f"{side}_id"), F.col(x).cast("double").alias(f"__{side}x"), F.col(y).cast("double").alias(f"__{side}y")).dropna()
    todo, points = cut(keep(left, left_id, "left").distinct()), cut(keep(right, right_id, "right").groupBy("__rightx", "__righty").agg(F.min("right_id").alias("right_id")))
    ends = points.agg(F.max("__rightx") - F.min("__rightx"), F.max("__righty") - F.min("__righty")).first()
    far = todo.agg(F.max(F.abs("__leftx")), F.max(F.abs("__lefty"))).first()
    reach = points.agg(F.max(F.abs("__rightx")), F.max(F.abs("__righty"))).first()
    if ends[0] is None or far[0] is None:
        return todo.join(points.select("right_id"), F.lit(False)).select("left_id", "right_id", F.lit(0.0).alias("distance"))
    widest = 2 * max(far[0] + reach[0], far[1] + reach[1], step)
    step = _uncrowded(points, step, widest)
    found: list[DataFrame] = []
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    while True:
        a = todo
        for k in "xy":
            a = a.withColumn(f"__c{k}", F.explode(F.transform(around, _plus(F.floor(F.col(f"__left{k}") / step)))))
        b = points.select("*", F.floor(F.col("__rightx") / step).alias("__cx"), F.floor(F.col("__righty") / step).alias("__cy"))
        distance = F.hypot(F.col("__leftx") - F.col("__rightx"), F.col("__lefty") - F.col("__righty"))
        # A least struct is found before the shuffle, so that a full cell sends a row a point and task.
        near = a.join(b, ["__cx", "__cy"]).groupBy("left_id").agg(F.min(F.struct(distance.alias("distance"), "right_id")).alias("__n"))
        near = cut(near.select("left_id", "__n.right_id", "__n.distance").where(F.col("distance") <= F.lit(step if step < widest else float("inf"))))
        found.append(near)
        if step >= widest:
            break
        todo = cut(todo.join(near, "left_id", "left_anti"))
        if todo.isEmpty():
            break
        step = min(2 * step, widest)
    return reduce(DataFrame.unionByName, found)


def polygon_join(points: DataFrame, polygons: DataFrame, *, point_id: str, polygon_id: str, ring: str, x: str = "x", y: str = "y", step: float) -> DataFrame:
    """Pairs ``point_id``, ``polygon_id`` of the points that lie in polygons, whose ``ring`` is an array of points (arrays of two numbers).

    Both meet in cells of ``step``, of which a polygon takes all that its box covers; a ray then counts the edges that it crosses. Points or rings that are null are in none.
    """
    corner = lambda k: F.transform(F.col(ring), lambda p: p[k].cast("double"))
    boxed = polygons.where(F.col(ring).isNotNull() & (F.size(ring) > 2)).select(F.col(polygon_id).alias("__g"), F.col(ring).alias("__r"), *[f(corner(k)).alias(f"__{n}{k}") for k in (0, 1) for n, f in (("a", F.array_min), ("b", F.array_max))])
    for k in (0, 1):
        boxed = boxed.withColumn(f"__c{k}", F.explode(F.sequence(F.floor(F.col(f"__a{k}") / step), F.floor(F.col(f"__b{k}") / step))))
    p = points.select(F.col(point_id).alias("__p"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).dropna(subset=["__x", "__y"])
    p = p.select("*", F.floor(F.col("__x") / step).alias("__c0"), F.floor(F.col("__y") / step).alias("__c1"))
    px, py = F.col("__x"), F.col("__y")

    def crosses(a: Column, b: Column) -> Column:
        straddles = (py < a[1]) != (py < b[1])
        return F.when(straddles, (px < (b[0] - a[0]) * (py - a[1]) / F.nullif(b[1] - a[1], F.lit(0.0)) + a[0]).cast("int")).otherwise(0)

    r = F.col("__r")
    edges = F.zip_with(r, F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1)), crosses)
    inside = F.aggregate(edges, F.lit(0), lambda s, e: s + e) % 2 == 1
    return p.join(boxed, ["__c0", "__c1"]).where(px.between(F.col("__a0"), F.col("__b0")) & py.between(F.col("__a1"), F.col("__b1"))).where(inside).select(F.col("__p").alias("point_id"), F.col("__g").alias("polygon_id"))


def grid_cell(value: Column | str, start: float, step: float) -> Column:
    """Number of the nearest point of a regular grid; halves go up."""
    c = F.col(value) if isinstance(value, str) else value
    return F.floor((c - start) / step + 0.5).cast("long")


FETCH_MODES = ("default", "missing-only", "retry-failed", "redownload-all")


def pending_stations(stations: DataFrame, history: DataFrame | None, archives: DataFrame, mode: str = "default") -> DataFrame:
    """Station codes to fetch. ``history`` has ``station_code`` and ``success``; ``archives`` has ``filename`` such as ``123_a.zip``.

    ``default`` leaves out those with a success or an archive, ``missing-only`` those ever tried or with an archive, ``retry-failed`` takes those that only failed.
    """
    if mode not in FETCH_MODES:
        raise ValueError(f"unknown mode {mode!r}; known are {FETCH_MODES}")
    todo = stations.select(F.col("station_code").cast("string").alias("station_code"))
    if mode == "redownload-all":
        return todo
    tried = None if history is None else history.select(F.col("station_code").cast("string").alias("station_code"), F.coalesce(F.col("success").cast("int"), F.lit(0)).alias("ok"))
    if mode == "retry-failed":
        if tried is None:
            return todo.limit(0)
        return todo.join(tried.where("ok = 0"), "station_code", "left_semi").join(tried.where("ok = 1"), "station_code", "left_anti")
    archived = archives.select(F.regexp_extract("filename", r"^(\d+)_", 1).alias("station_code")).where("station_code <> ''")
    left = todo.join(archived, "station_code", "left_anti")
    return left if tried is None else left.join(tried.where("ok = 1") if mode == "default" else tried, "station_code", "left_anti")


def fetch_states(stations: DataFrame, history: DataFrame, archives: DataFrame, mode: str = "default") -> DataFrame:
    """``station_code``, ``state`` and ``attempt`` (whether ``mode`` tries it) of every station.

    A station has ``succeeded`` if an attempt did, else is ``archived`` if a file of it is there, else has ``failed`` if it was tried, else is ``new``.
    """
    code = F.col("station_code").cast("string").alias("station_code")
    tried = history.select(code, F.coalesce(F.col("success").cast("boolean"), F.lit(False)).alias("ok")).groupBy("station_code").agg(F.bool_or("ok").alias("__ok"))
    filed = archives.select(F.regexp_extract("filename", r"^(\d+)_", 1).alias("station_code")).distinct().withColumn("__filed", F.lit(True))
    asked = pending_stations(stations, history, archives, mode).distinct().withColumn("__asked", F.lit(True))
    joined = stations.select(code).join(tried, "station_code", "left").join(filed, "station_code", "left").join(asked, "station_code", "left")
    state = F.when(F.col("__ok"), "succeeded").when(F.col("__filed"), "archived").when(F.col("__ok").isNotNull(), "failed").otherwise("new")
    return joined.select("station_code", state.alias("state"), F.coalesce("__asked", F.lit(False)).alias("attempt"))


def merge_attempts(log: DataFrame, station: str = "station_code", at: str = "attempted_at") -> DataFrame:
    """One row a station: attempts added up, and the status and error of the last."""
    last = F.max_by(F.struct("status", "last_error"), F.struct(F.col(at), F.col("run_id")))
    return log.groupBy(station).agg(F.sum("attempts").alias("attempts"), last.alias("__l")).select(station, "attempts", "__l.status", "__l.last_error")
