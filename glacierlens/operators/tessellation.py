"""Polygons as leaf cells of an adaptive quadtree, for point lookups by one join.

All polygons share one tree.  A cell that more than ``LEAF_EDGES`` edges touch is
split, so a row of the index is bounded however long or crowded the outlines are.
Each leaf holds a row's worth of polygons: for each, the edges that touch the cell, and whether
the cell's reference point lies inside.  A polygon without an edge in the cell
holds all of it or none, and needs no point test.  For the others a point's parity
is that of the reference point, plus the crossings of the way from there to the
point, which stays within the cell: up or down first, then along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.session import settle, shared_folder

# edges that touch a leaf at most, where the tree isn't at its deepest
LEAF_EDGES = 256
# halvings of a first cell at most (about 27 m from one degree)
DEEPEST = 12
# place of a cell's reference point: off any coordinate that outlines are likely to have
REF_X, REF_Y = 0.3819660112501051, 0.2763932022500210
# an edge belongs to a cell that it comes this close to, in sizes of the cell
REACH = 1e-9

POLYGON = ["hier", "id"]
CELL = ["level", "cx", "cy"]
EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def outline_edges(polygons: DataFrame) -> DataFrame:
    """``hier, id, x1, y1, x2, y2`` of closed rings ``hier, id, ring, vertex, x, y``, in their direction."""
    ring = Window.partitionBy(*POLYGON, "ring").orderBy("vertex")
    ends = polygons.select("hier", F.col("id").cast("long").alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(ring).alias("x2"), F.lead("y").over(ring).alias("y2"))
    return ends.where(F.col("x2").isNotNull() & F.col("y2").isNotNull())


def crosses_level(y: Column, e) -> Column:
    """Whether an edge crosses a level; a vertex on it counts as below."""
    return (e("y1") > y) != (e("y2") > y)


def at_level(y: Column, e) -> Column:
    return F.try_divide((e("x2") - e("x1")) * (y - e("y1")), e("y2") - e("y1")) + e("x1")


def _swapped(e):
    """An edge with x and y exchanged."""
    return lambda name: e({"x": "y", "y": "x"}[name[0]] + name[1])


def way_crossings(x0: Column, y0: Column, x: Column, y: Column, e) -> Column:
    """Crossings of an edge with the way from (x0, y0) upright to y, then level to x."""
    up, level = _swapped(e), at_level(y, e)
    met = at_level(x0, up)
    upright = crosses_level(x0, up) & ((met > y0) != (met > y))
    along = crosses_level(y, e) & ((level > x0) != (level > x))
    return F.when(upright, 1).otherwise(0) + F.when(along, 1).otherwise(0)


def _touched(edges: DataFrame, size: float) -> DataFrame:
    """Edges once for each cell they touch."""
    near = REACH * size
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("cy", F.explode(F.sequence(F.floor((low - near) / size), F.floor((high + near) / size))))
    # the edge's part within the row of cells
    bottom = F.greatest(low, F.least(high, F.col("cy") * size - near))
    top = F.least(high, F.greatest(low, (F.col("cy") + 1) * size + near))
    slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    a, b = F.col("x1") + (bottom - F.col("y1")) * slope, F.col("x1") + (top - F.col("y1")) * slope
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    from_x = F.coalesce(F.greatest(left, F.least(a, b)), left)
    to_x = F.coalesce(F.least(right, F.greatest(a, b)), right)
    return rows.withColumn("cx", F.explode(F.sequence(F.floor((from_x - near) / size), F.floor((to_x + near) / size))))


def _first_cells(edges: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Touched first cells with their edges, and ``parity`` of every touched or wholly inner cell.

    A polygon's crossings with the level of a row's reference points are counted by
    the first cell that lies behind them; sums along the row are the parities.
    """
    touched = _touched(edges, size)
    e = F.col
    row = F.explode(F.sequence(F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size)))
    level = (F.col("cy") + REF_Y) * size
    hits = edges.withColumn("cy", row).where(crosses_level(level, e))
    hits = hits.select(*POLYGON, "cy", (F.floor(at_level(level, e) / size - REF_X) + 1).alias("cx"), F.lit(1).alias("n"), F.lit(0).alias("own"))
    own = touched.select(*POLYGON, "cy", "cx").distinct().select(*POLYGON, "cy", "cx", F.lit(0).alias("n"), F.lit(1).alias("own"))
    events = hits.union(own).groupBy(*POLYGON, "cy", "cx").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
    line = Window.partitionBy(*POLYGON, "cy").orderBy("cx")
    events = events.withColumns({"parity": (F.sum("n").over(line) % 2).cast("int"), "next": F.lead("cx").over(line)})
    # cells behind an event have its parity until the next one
    gap = F.when((F.col("parity") == 1) & (F.col("next") > F.col("cx") + 1), F.sequence(F.col("cx") + 1, F.col("next") - 1))
    here = F.when((F.col("own") == 1) | (F.col("parity") == 1), F.array("cx")).otherwise(F.array().cast("array<bigint>"))
    cells = events.select(*POLYGON, "cy", "parity", F.explode(F.concat(here, F.coalesce(gap, F.array().cast("array<bigint>")))).alias("cx"))
    return touched, cells


def _children(cells: DataFrame) -> DataFrame:
    half = F.array(F.lit(0), F.lit(1))
    both = cells.withColumn("_i", F.explode(half)).withColumn("_j", F.explode(half))
    moved = {"cx": F.col("cx") * 2 + F.col("_i"), "cy": F.col("cy") * 2 + F.col("_j")}
    return both.withColumns({"px": F.col("cx"), "py": F.col("cy")}).withColumns(moved).drop("_i", "_j")


def tessellate(polygons: DataFrame, size: float = 1.0) -> tuple[DataFrame, DataFrame | None, int]:
    """Leaves ``level, cx, cy, x0, y0, polys``; split first cells with their depth (None without any); number of edges listed.

    ``polys`` has ``hier, id, parity, edges`` of each polygon that touches or holds the leaf; leaves of
    a split cell without any are listed too, so that each point of it lies in one leaf.
    """
    shared_folder(polygons.sparkSession)
    # numbered, as an outline may hold equal edges
    edges = outline_edges(polygons).withColumn("edge", F.monotonically_increasing_id()).checkpoint()
    touched, cells = _first_cells(edges, size)
    touched, cells = touched.checkpoint(), cells.checkpoint()
    level, leaves, split = 0, [], None
    while True:
        step = size / 2**level
        counts = touched.groupBy("cx", "cy").agg(F.count("*").alias("n"))
        full = settle(counts.where(F.col("n") > (LEAF_EDGES if level < DEEPEST else 1 << 62)).select("cx", "cy"))
        last = full.isEmpty()
        keep_edges = touched if last else touched.join(full, ["cx", "cy"], "left_anti")
        keep = cells if last else cells.join(full, ["cx", "cy"], "left_anti")
        listed = keep_edges.groupBy("cx", "cy", *POLYGON).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
        done = keep.join(listed, ["cx", "cy", *POLYGON], "left")
        leaves.append(done.select(F.lit(level).alias("level"), "cx", "cy", *POLYGON, "parity", F.coalesce("edges", F.array().cast(EDGES)).alias("edges")))
        if last:
            break
        if split is None:
            split = full.select(F.col("cx").alias("fx"), F.col("cy").alias("fy"), F.lit(1).alias("depth"))
        else:
            shift = 2**level
            deeper = full.select(F.floor(F.col("cx") / shift).alias("fx"), F.floor(F.col("cy") / shift).alias("fy"), F.lit(level + 1).alias("depth"))
            split = split.union(deeper)
        # the four children of a split cell: their reference points by the way from the cell's own
        ahead = _children(cells.join(full, ["cx", "cy"]))
        inner = touched.join(full, ["cx", "cy"])
        half = step / 2
        way = way_crossings((F.col("px") + REF_X) * step, (F.col("py") + REF_Y) * step, (F.col("cx") + REF_X) * half, (F.col("cy") + REF_Y) * half, F.col)
        crossed = _children(inner).groupBy(*POLYGON, "cx", "cy").agg(F.sum(way).alias("crossed"))
        placed = ahead.join(crossed, [*POLYGON, "cx", "cy"], "left")
        parity = ((F.col("parity") + F.coalesce("crossed", F.lit(0))) % 2).cast("int")
        # an empty leaf of no polygon stands for what lies in none
        hollow = _children(full).select(F.lit(None).cast("string").alias("hier"), F.lit(None).cast("long").alias("id"), "cx", "cy", F.lit(0).alias("parity"))
        level += 1
        inner = _touched(inner.select(*POLYGON, "edge", "x1", "y1", "x2", "y2").distinct(), half)
        # only children of split cells: the edge may touch others, which have their own
        parents = full.select(F.col("cx").alias("px"), F.col("cy").alias("py"))
        inner = inner.withColumns({"px": F.floor(F.col("cx") / 2), "py": F.floor(F.col("cy") / 2)}).join(parents, ["px", "py"], "left_semi").drop("px", "py")
        touched = inner.checkpoint()
        own = touched.select(*POLYGON, "cx", "cy").distinct().withColumn("own", F.lit(1))
        found = placed.select(*POLYGON, "cx", "cy", parity.alias("parity")).join(own, [*POLYGON, "cx", "cy"], "left")
        found = found.where("own = 1 or parity = 1").drop("own")
        cells = found.unionByName(hollow).checkpoint()
    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    poly = F.struct("hier", "id", "parity", "edges")
    index = rows.groupBy(*CELL).agg(F.collect_list(F.when(F.col("id").isNotNull(), poly)).alias("polys"), F.sum(F.size("edges")).alias("n"))
    step = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
    index = index.select(*CELL, ((F.col("cx") + REF_X) * step).alias("x0"), ((F.col("cy") + REF_Y) * step).alias("y0"), "polys", "n").checkpoint()
    if split is not None:
        split = settle(split.groupBy("fx", "fy").agg(F.max("depth").alias("depth")))
    return index.drop("n"), split, index.agg(F.sum("n")).first()[0] or 0


def holds(poly: Column, px: Column, py: Column, x0: Column, y0: Column) -> Column:
    """Whether a leaf's polygon holds a point of the leaf; a point on an edge is inside."""
    edges = poly["edges"]

    def on_edge(e):
        cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
        level = py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        return (cross == 0) & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & level

    count = F.aggregate(edges, poly["parity"], lambda acc, e: acc + way_crossings(x0, y0, px, py, lambda name: e[name]))
    return (count % 2 == 1) | F.exists(edges, on_edge)


def lookup(points: DataFrame, index: tuple, lon: str, lat: str, size: float, out: str, broadcast_edges: int) -> DataFrame:
    """Points with ``out``, the array of (hier, id) of all polygons that hold them; one row for each point."""
    leaves, split, n_edges = index
    px, py = F.col(lon), F.col(lat)
    rows = points.withColumns({"_fx": F.floor(px / size), "_fy": F.floor(py / size)})
    if split is None:
        rows = rows.withColumns({"_level": F.lit(0), "_depth": F.lit(0)})
    else:
        rows = rows.join(split.select(F.col("fx").alias("_fx"), F.col("fy").alias("_fy"), F.col("depth").alias("_depth")), ["_fx", "_fy"], "left")
        rows = rows.withColumn("_level", F.explode(F.sequence(F.lit(0), F.coalesce("_depth", F.lit(0)))))
    step = F.lit(float(size)) / F.pow(F.lit(2.0), F.col("_level"))
    cell_x, cell_y = (F.col("_fx"), F.col("_fy")) if split is None else (F.floor(px / step), F.floor(py / step))
    rows = rows.withColumns({"_cx": cell_x, "_cy": cell_y})
    side = leaves.select(F.col("level").alias("_level"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("x0").alias("_x0"), F.col("y0").alias("_y0"), F.col("polys").alias("_polys"))
    side = F.broadcast(side) if n_edges <= broadcast_edges else side
    found = rows.join(side, ["_level", "_cx", "_cy"], "left")
    if split is not None:
        # a split cell's points lie in one leaf each; the other levels have no row for them
        found = found.where(F.col("_polys").isNotNull() | F.col("_depth").isNull())
    kind = "array<struct<hier:string,id:bigint>>"
    inside = F.filter("_polys", lambda p: holds(p, px, py, F.col("_x0"), F.col("_y0")))
    hits = F.transform(inside, lambda p: F.struct(p["hier"].alias("hier"), p["id"].cast("long").alias("id"))).cast(kind)
    return found.withColumn(out, F.coalesce(hits, F.array().cast(kind))).select(*points.columns, out)
