"""Point-in-polygon tags, raster sampling, zonal means, nearest grid points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.functions.scalars import haversine
from glacierlens.operators.tessellation import lookup, outline_edges, tessellate
from glacierlens.session import shared_folder

# a polygon index is broadcast up to this many edges (32 bytes each)
BROADCAST_EDGES = 2_000_000
# shares below this are rounding
COVER_DUST = 1e-12
# grid points per cell when a nearest-point search starts
GRID_OCCUPANCY = 32


def placed_index(polygons: DataFrame, size: float = 1.0) -> tuple:
    """The tessellated polygon index, for several calls of :func:`containing` with one ``size``."""
    return tessellate(polygons, size)


def containing(points: DataFrame, polygons: DataFrame, lon: str = "lon", lat: str = "lat", size: float = 1.0, index=None) -> DataFrame:
    """Points with ``_in``, the array of (hier, id) of all polygons around them.

    One join with the leaves of the tessellation: a map-side lookup when its edges
    are few enough to broadcast, otherwise a join on the leaf, whose hot cells AQE
    splits.  ``index`` is a :func:`placed_index` of the same size, where several
    calls share it.
    """
    return lookup(points, index or placed_index(polygons, size), lon, lat, size, "_in", BROADCAST_EDGES)


def tag_regions(points: DataFrame, polygons: DataFrame, hiers: Sequence[str], **kw) -> DataFrame:
    """One id column per hierarchy: the highest containing id, 0 if none."""
    found = containing(points, polygons, **kw)

    def highest(hier):
        ids = F.transform(F.filter("_in", lambda h: h["hier"] == hier), lambda h: h["id"])
        return F.coalesce(F.array_max(ids), F.lit(0)).cast("int").alias(hier)

    cols = [highest(k) for k in hiers]
    return found.select(*points.columns, *cols)


def outside_all(points: DataFrame, polygons: DataFrame, **kw) -> DataFrame:
    """Points in no polygon; cells without a polygon pass."""
    return containing(points, polygons, **kw).where(F.size("_in") == 0).select(*points.columns)


def within_boundary(points: DataFrame, polygon: DataFrame, **kw) -> DataFrame:
    return containing(points, polygon, **kw).where(F.size("_in") > 0).select(*points.columns)


def select_glaciers(glaciers: DataFrame, regions: DataFrame) -> DataFrame:
    """(glacier, region) for each region that holds the glacier's centroid."""
    found = containing(glaciers, regions, lon="cen_lon", lat="cen_lat")
    return found.select(*glaciers.columns, F.explode("_in").alias("_h")).select(
        *glaciers.columns, F.col("_h.id").alias("region_id")
    )


class Affine:
    """North-up raster geometry: upper-left corner and pixel sizes."""

    def __init__(self, lon0: float, lat0: float, dx: float, dy: float):
        self.lon0, self.lat0, self.dx, self.dy = map(float, (lon0, lat0, dx, dy))

    def row(self, lat: Column) -> Column:
        """0-based row of the pixel whose 1-based index is ceil()."""
        return (F.ceil((F.lit(self.lat0) - lat) / self.dy) - 1).cast("long")

    def col(self, lon: Column) -> Column:
        return (F.ceil((lon - F.lit(self.lon0)) / self.dx) - 1).cast("int")


def locate(points: DataFrame, affine: Affine) -> DataFrame:
    return points.withColumn("r", affine.row(F.col("lat"))).withColumn("c", affine.col(F.col("lon")))


def sample_raster(points: DataFrame, pixel: DataFrame, affine: Affine, out: str = "value") -> DataFrame:
    """Value of the pixel under each point, NULL outside the grid.

    An equi-join on (row, col); a hot pixel is split by AQE's skew join.
    """
    px = pixel.select("r", "c", F.col("value").alias(out))
    return locate(points, affine).join(px, ["r", "c"], "left")


def focal_table(pixel: DataFrame, k: int) -> DataFrame:
    """Mean over the k x k neighbourhood of each pixel, missing pixels skipped.

    Two sliding sums, down the columns then along the rows, instead of k*k
    copies of each pixel.  A window holds one raster line at most.  Pixels
    whose window crosses the edge of the grid get none.
    """
    h = k // 2
    ok = F.col("value").isNotNull() & ~F.isnan("value")
    down = Window.partitionBy("c").orderBy("r").rangeBetween(-h, h)
    along = Window.partitionBy("r").orderBy("c").rangeBetween(-h, h)
    sums = pixel.select(
        "r", "c",
        F.sum(F.when(ok, F.col("value")).otherwise(0.0)).over(down).alias("_s"),
        F.sum(F.when(ok, 1).otherwise(0)).over(down).alias("_n"),
    ).select(
        "r", "c", F.sum("_s").over(along).alias("_s"), F.sum("_n").over(along).alias("_n")
    )
    # the grid limits, one value of a scalar subquery
    box = pixel.agg(
        F.struct(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    ).scalar()
    r, c = F.col("r"), F.col("c")
    whole = (r - h >= box["r0"]) & (r + h <= box["r1"]) & (c - h >= box["c0"]) & (c + h <= box["c1"])
    return sums.where(whole & (F.col("_n") > 0)).select("r", "c", (F.col("_s") / F.col("_n")).alias("focal"))


def focal_mean(points: DataFrame, pixel: DataFrame, affine: Affine, k: int) -> DataFrame:
    return locate(points, affine).join(focal_table(pixel, k), ["r", "c"], "left")


def mask_split(points: DataFrame, mask: DataFrame, affine: Affine) -> DataFrame:
    """on_glacier by the mask under the point; outside the grid is off."""
    px = mask.select("r", "c", F.col("mask").alias("_m"))
    joined = locate(points, affine).join(px, ["r", "c"], "left")
    return joined.withColumn("on_glacier", F.coalesce(F.col("_m"), F.lit(False))).drop("_m")


def coverage_weights(pixel: DataFrame, polygons: DataFrame, affine: Affine) -> DataFrame:
    """``id, r, c, w``: the exact share of each pixel that lies inside each polygon.

    Edges are cut at the lines and columns of the raster.  A piece covers the part
    of its pixel to the right of it, and all pixels of the line behind: signed by
    its direction, the sums along a line are the shares.  Pixels between two cut
    ones have one share and are filled in.  Holes run against their outer ring, as
    in the usual file formats, so they take away what they hold.
    """
    box = pixel.agg(F.struct((F.max("r") + 1).alias("r"), (F.max("c") + 1).alias("c"))).scalar()
    to_x, to_y = lambda x: (F.col(x) - affine.lon0) / affine.dx, lambda y: (affine.lat0 - F.col(y)) / affine.dy
    edges = outline_edges(polygons).select("id", to_x("x1").alias("x1"), to_y("y1").alias("y1"), to_x("x2").alias("x2"), to_y("y2").alias("y2"))
    slope = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    r0, r1 = F.greatest(F.floor(low), F.lit(0).cast("long")), F.least(F.ceil(high) - 1, box["r"] - 1)
    lines = edges.where((F.col("y1") != F.col("y2")) & (r1 >= r0)).withColumn("r", F.explode(F.sequence(r0, r1)))

    def cut(v, at):
        return F.least(F.greatest(v, at), at + 1)

    # the edge within the line, in its direction
    lines = lines.withColumns({"ya": cut(F.col("y1"), F.col("r")), "yb": cut(F.col("y2"), F.col("r"))})
    x_at = lambda y: F.col("x1") + (F.col(y) - F.col("y1")) * slope[0] / slope[1]
    lines = lines.select("id", "r", x_at("ya").alias("xa"), "ya", x_at("yb").alias("xb"), "yb")
    # what lies to the left of the raster covers its lines from the first pixel on
    left, right = F.least("xa", "xb"), F.greatest("xa", "xb")
    c0 = F.greatest(F.floor(left), F.lit(-1).cast("long"))
    c1 = F.greatest(F.least(F.ceil(right) - 1, box["c"] - 1), c0)
    pieces = lines.where(left < box["c"]).withColumn("c", F.explode(F.sequence(c0, c1)))
    first, last = F.col("c") == c0, F.col("c") == c1
    # the outermost columns take all that goes beyond them on the left
    near = F.when(first, left).otherwise(F.col("c").cast("double"))
    far = F.when(last & (c1 < box["c"] - 1), right).otherwise(F.least(right, F.col("c") + 1.0))
    share = F.when(right > left, (far - near) / (right - left)).otherwise(F.lit(1.0))
    dy = (F.col("yb") - F.col("ya")) * share
    middle = F.greatest((near + far) / 2, F.col("c").cast("double"))
    pieces = pieces.select("id", "r", "c", dy.alias("cover"), (dy * (F.col("c") + 1 - middle)).alias("area"))
    sums = pieces.groupBy("id", "r", "c").agg(F.sum("cover").alias("cover"), F.sum("area").alias("area"))
    # a line has a row for each pixel that an edge cuts
    line = Window.partitionBy("id", "r").orderBy("c")
    sums = sums.withColumns({"after": F.sum("cover").over(line), "next": F.coalesce(F.lead("c").over(line), F.lit(0).cast("long") + box["c"])})
    here = F.struct(F.col("c").alias("c"), (F.col("after") - F.col("cover") + F.col("area")).alias("w"))
    full = (F.abs("after") > COVER_DUST) & (F.col("next") > F.col("c") + 1)
    between = F.transform(F.when(full, F.sequence(F.col("c") + 1, F.col("next") - 1)).otherwise(F.array().cast("array<bigint>")), lambda c: F.struct(c.alias("c"), F.col("after").alias("w")))
    cells = sums.select("id", "r", F.explode(F.concat(F.array(here), between)).alias("p")).select("id", "r", "p.c", F.least(F.abs("p.w"), F.lit(1.0)).alias("w"))
    return cells.where((F.col("c") >= 0) & (F.col("w") > COVER_DUST)).select("id", "r", F.col("c").cast("int").alias("c"), "w")


def zonal_mean(features: DataFrame, weights: DataFrame, pixel: DataFrame, bands: Sequence[str] = ("value",),
               by: Sequence[str] = ()) -> DataFrame:
    """Coverage-weighted mean of each band per feature; no cover gives NULL."""
    joined = weights.join(pixel, ["r", "c"])
    aggs = []
    for b in bands:
        ok = F.when(F.col(b).isNotNull() & ~F.isnan(b), F.col("w"))
        aggs.append(F.try_divide(F.sum(ok * F.col(b)), F.sum(ok)).alias(b))
    means = joined.groupBy("id", *by).agg(*aggs)
    return features.select("id").distinct().join(means, "id", "left")


def nearest_grid_point(targets: DataFrame, grid: DataFrame, key: str, lon: str = "cen_lon", lat: str = "cen_lat",
                       cell: float = 1.0) -> DataFrame:
    """Grid point with the least squared degree distance, first index on ties.

    Grid points at one place count once, with their first index.  The first
    cell size is halved until no cell holds more than ``GRID_OCCUPANCY`` points.
    Each target looks into the 3 x 3 cells around it.  A hit closer than one
    cell is final; the other targets repeat with cells twice as large, until
    the 3 x 3 block covers the globe.
    """
    shared_folder(targets.sparkSession)
    pending = targets.select(key, F.col(lon).alias("_tx"), F.col(lat).alias("_ty"))
    g = grid.groupBy(F.col("lon").alias("grid_lon"), F.col("lat").alias("grid_lat")).agg(F.min("idx").alias("idx")).checkpoint()

    def celled(size):
        return g.withColumn("_cx", F.floor(F.col("grid_lon") / size)).withColumn("_cy", F.floor(F.col("grid_lat") / size))

    size = float(cell)
    while size > 1e-6:
        fullest = celled(size).groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0] or 0
        if fullest <= GRID_OCCUPANCY:
            break
        size /= 2
    found = None
    while True:
        three = F.array(F.lit(-1), F.lit(0), F.lit(1))
        cx, cy = F.floor(F.col("_tx") / size), F.floor(F.col("_ty") / size)
        around = pending.withColumn("_cx", cx).withColumn("_cy", cy)
        around = around.withColumn("_dx", F.explode(three)).withColumn("_dy", F.explode(three)).select(
            key, "_tx", "_ty", (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy")
        )
        d2 = F.pow(F.col("_tx") - F.col("grid_lon"), 2) + F.pow(F.col("_ty") - F.col("grid_lat"), 2)
        best = around.join(celled(size), ["_cx", "_cy"]).groupBy(key, "_tx", "_ty").agg(
            F.min(F.struct(d2.alias("d2"), "idx", "grid_lon", "grid_lat")).alias("_b")
        )
        last = size >= 360
        final = (best if last else best.where(F.col("_b.d2") < size * size)).checkpoint()
        found = final if found is None else found.unionByName(final)
        if last:
            break
        pending = pending.join(final, key, "left_anti").checkpoint()
        if pending.isEmpty():
            break
        size *= 2
    return found.select(
        key, F.col("_b.idx").alias("idx"), F.col("_b.grid_lon").alias("grid_lon"), F.col("_b.grid_lat").alias("grid_lat"),
        haversine("_tx", "_ty", "_b.grid_lon", "_b.grid_lat").alias("distance_m"),
    )


def share_edge(polygons: DataFrame) -> DataFrame:
    """Neighbouring polygons and the length of their identical edges, each pair once."""
    ring = Window.partitionBy("id", "ring").orderBy("vertex")
    seg = polygons.select(
        "id", F.struct("x", "y").alias("_p"), F.lead(F.struct("x", "y")).over(ring).alias("_q")
    ).where(F.col("_q").isNotNull()).select(
        "id", F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b")
    ).distinct()
    left = seg.select(F.col("id").alias("id_1"), "a", "b")
    right = seg.select(F.col("id").alias("id_2"), "a", "b")
    length = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    return left.join(right, ["a", "b"]).where(F.col("id_1") < F.col("id_2")).groupBy("id_1", "id_2").agg(
        F.sum(length).alias("shared_length")
    )


def align_obs_sim(obs: DataFrame, sim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs by key where both sides have a value."""
    return obs.join(sim, list(keys)).dropna(subset=["obs", "sim"])


def join_reference(model: DataFrame, ref: DataFrame, key: str = "rgi_id", fallback: bool = True) -> DataFrame:
    """Model balances with geodetic reference rows, measured ones preferred.

    With ``fallback`` the corrected rows are used only if no measured row
    matches any modelled glacier.
    """
    joined = model.join(ref, key)
    keep = ~F.col("is_cor")
    if fallback:
        measured = joined.agg(F.count_if(~F.col("is_cor"))).scalar()
        keep = keep | (measured == 0)
    return joined.where(keep)

