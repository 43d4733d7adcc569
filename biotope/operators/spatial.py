"""Points, pixels and grid cells against site polygons, on projected coordinates.

Polygons are covered by cells of a quadtree: a cell is split until few edges touch it, so wide inner parts are a few large
cells that need no edge test, and a fine outline is many small cells with a bounded number of edges each. A point looks
up its own cell on each of the levels present. Whether it is inside follows from the known parity of a corner of the
cell and the edges that cross the way from there, which all touch the cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotope.session import materialize

BOX = ("x_min", "x_max", "y_min", "y_max")


def with_box(polygons: DataFrame, rings: str) -> DataFrame:
    """Bounding box of the outer ring."""
    outer = F.get(rings, F.lit(0))
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    return polygons.select(
        "*",
        F.array_min(xs).alias("x_min"),
        F.array_max(xs).alias("x_max"),
        F.array_min(ys).alias("y_min"),
        F.array_max(ys).alias("y_max"),
    )


def with_edges(polygons: DataFrame, site: str, rings: str) -> DataFrame:
    """One row per polygon part: site, box and edges, from closed rings of ``struct<x, y>``.

    ``rings`` is ``array<array<struct<x,y>>>``: the outer ring and its holes.
    """
    def ring_edges(ring: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(ring) - 1),
            lambda i: F.struct(
                F.get(ring, i - 1)["x"].alias("x1"),
                F.get(ring, i - 1)["y"].alias("y1"),
                F.get(ring, i)["x"].alias("x2"),
                F.get(ring, i)["y"].alias("y2"),
            ),
        )

    boxed = with_box(polygons, rings)
    return boxed.select(site, F.flatten(F.transform(rings, ring_edges)).alias("edges"), *BOX)


def bucket(coordinate: Column, size: float) -> Column:
    return F.floor(coordinate / F.lit(float(size))).cast("int")


def over_buckets(shapes: DataFrame, size: float) -> DataFrame:
    """One row per shape and square bucket its box overlaps."""
    columns = shapes.select(
        "*", F.explode(F.sequence(bucket(F.col("x_min"), size), bucket(F.col("x_max"), size))).alias("bx")
    )
    return columns.select(
        "*", F.explode(F.sequence(bucket(F.col("y_min"), size), bucket(F.col("y_max"), size))).alias("by")
    )


#: Edges up to which a cell is not split, and levels below the cell that holds the largest shape.
MOST_EDGES, MOST_LEVELS = 16, 24
#: A cell's corner of reference lies beyond it by these shares of its size, so that no outline given in round numbers
#: runs through it or along the way to it.
BEYOND_X, BEYOND_Y = 0.0137035999, 0.0072973525
#: Rows of the covering (some hundred bytes each) that are sent to every task; salts of a cell where there are more.
SENT_CELLS, SALTS = 50_000, 32


def _odd_across(edges: Column, y: Column, x_from: Column, x_to: Column) -> Column:
    """Whether an odd number of edges cross the way from x_from to x_to at height y."""

    def crosses(e: Column) -> Column:
        # an edge that spans the height is not horizontal, so the divisor is not 0 there
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & ((x_from < at) != (x_to < at))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def _odd_along(edges: Column, x: Column, y_from: Column, y_to: Column) -> Column:
    """Whether an odd number of edges cross the way from y_from to y_to at x."""

    def crosses(e: Column) -> Column:
        at = (e["y2"] - e["y1"]) * (x - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0)) + e["y1"]
        return ((e["x1"] > x) != (e["x2"] > x)) & ((y_from < at) != (y_to < at))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def _corner(size: float, cx: str = "cx", cy: str = "cy") -> tuple[Column, Column]:
    """Corner of reference of the cell (cx, cy): beyond its right side, below its bottom."""
    return (F.col(cx) + 1 + BEYOND_X) * F.lit(size), (F.col(cy) - BEYOND_Y) * F.lit(size)


def _holder(x: Column, y: Column, right: Column, low: Column) -> Callable[[Column], Column]:
    """Test whether a shape of a cell with this corner of reference holds the point."""
    return lambda s: s["odd"] != (_odd_along(s["edges"], right, low, y) != _odd_across(s["edges"], y, x, right))


def _touching(edges: Column, size: float) -> Column:
    """Edges that reach into the cell (cx, cy) or the strip up to its corner of reference.

    An edge does not where it ends beyond one side, or all four corners lie on one side of its line.
    """
    right, low = _corner(size)
    left, high = F.col("cx") * F.lit(size), (F.col("cy") + 1) * F.lit(size)

    def touches(e: Column) -> Column:
        near = (F.least(e["x1"], e["x2"]) <= right) & (F.greatest(e["x1"], e["x2"]) >= left) & (F.least(e["y1"], e["y2"]) <= high) & (F.greatest(e["y1"], e["y2"]) >= low)
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        sides = [dx * (y - e["y1"]) - dy * (x - e["x1"]) for x in (left, right) for y in (low, high)]
        slack = (F.abs(dx) + F.abs(dy)) * F.lit(size * 1e-9)
        return near & (F.least(*sides) <= slack) & (F.greatest(*sides) >= -slack)

    return F.filter(edges, touches)


def cover(shapes: DataFrame, site: str, most_edges: int = MOST_EDGES, most_levels: int = MOST_LEVELS) -> tuple[DataFrame, float]:
    """(level, cx, cy, site, odd, edges) of the cells that cover the shapes, and the size of a cell of level 0.

    ``odd`` tells whether the cell's corner of reference is inside. A cell without edges lies wholly inside. Cells are
    halved in both directions until at most ``most_edges`` edges touch them; only where more edges meet in one
    point do cells of the last level keep them all. A level is one pass over the cells still to be split.
    """
    known = shapes.where("x_min is not null and y_min is not null")
    widest = known.agg(F.max(F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")))).first()[0] or 1.0
    size = whole = 2.0 ** math.ceil(math.log2(max(widest, 1e-9)))
    cells = over_buckets(known, size).select(F.col(site).alias("site"), F.col("bx").cast("long").alias("cx"), F.col("by").cast("long").alias("cy"), F.col("edges").alias("all_edges"), "x_max")
    right, low = _corner(size)
    odd = _odd_across(F.col("all_edges"), low, right, F.greatest(F.col("x_max"), right) + 1.0)
    cells = cells.select("site", F.lit(0).alias("level"), "cx", "cy", odd.alias("odd"), _touching(F.col("all_edges"), size).alias("edges"))
    done = []
    for level in range(most_levels + 1):
        now = materialize(cells.where("size(edges) > 0 or odd"), "cells")
        split = F.size("edges") > most_edges if level < most_levels else F.lit(False)
        done.append(now.where(~split))
        if now.where(split).isEmpty():
            break
        right, low = _corner(size)
        half = size / 2
        parent = now.where(split).select("site", "odd", F.col("edges").alias("held"), right.alias("x_from"), low.alias("y_from"), F.explode(F.array(*[
            F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)
        ])).alias("child")).select("site", "odd", "held", "x_from", "y_from", "child.*")
        x, y = _corner(half)
        moved = F.col("odd") != (_odd_along(F.col("held"), F.col("x_from"), F.col("y_from"), y) != _odd_across(F.col("held"), y, x, F.col("x_from")))
        cells = parent.select("site", F.lit(level + 1).alias("level"), "cx", "cy", moved.alias("odd"), _touching(F.col("held"), half).alias("edges"))
        size = half
    return reduce(DataFrame.union, done), whole


def locate(points: DataFrame, shapes: DataFrame, site: str, x: str, y: str, name: str = "site", most_edges: int = MOST_EDGES) -> DataFrame:
    """Site containing each point, the smallest code where sites overlap, NULL outside all.

    ``shapes`` comes from ``with_edges``; a multipolygon is several rows of one site. Points keep their rows. A covering
    of few cells is sent to the points; a larger one meets them by cell and a salt, so a crowded cell is many tasks.
    """
    covering, whole = cover(shapes, site, most_edges)
    shape = F.struct("site", "odd", "edges")
    listed = materialize(covering.groupBy("level", "cx", "cy").agg(F.sort_array(F.collect_list(shape)).alias("shapes")), "covering")
    counts = {r.level: r.n for r in listed.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row for each level
    joined, hits = points, []
    for level, n in sorted(counts.items()):
        size = whole / 2**level
        mine = listed.where(F.col("level") == level).select(F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), F.col("shapes").alias(f"__shapes_{level}"))
        cx, cy = F.floor(F.col(x) / F.lit(size)), F.floor(F.col(y) / F.lit(size))
        if n <= SENT_CELLS:
            joined = joined.join(F.broadcast(mine), (cx == F.col("__cx")) & (cy == F.col("__cy")), "left")
        else:
            salt = F.pmod(F.xxhash64(x, y), F.lit(SALTS))
            spread = mine.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
            joined = joined.join(spread, (cx == F.col("__cx")) & (cy == F.col("__cy")) & (salt == F.col("__salt")), "left").drop("__salt")
        holds = _holder(F.col(x), F.col(y), *_corner(size, "__cx", "__cy"))
        hit = F.get(F.filter(f"__shapes_{level}", holds), F.lit(0))["site"]
        joined = joined.withColumn(f"__hit_{level}", hit).drop("__cx", "__cy", f"__shapes_{level}")
        hits.append(F.col(f"__hit_{level}"))
    found = F.array_min(F.array(*hits)) if hits else F.lit(None).cast(shapes.schema[site].dataType)
    return joined.select(*points.columns, found.alias(name))


def zonal_pixels(
    pixels: DataFrame, shapes: DataFrame, site: str, x: str, y: str, value: str, nodata: float
) -> DataFrame:
    """Pixels with a usable value whose centre lies in a site."""
    usable = pixels.where(
        F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & (F.col(value) != nodata)
    )
    return locate(usable, shapes, site, x, y).where("site is not null")


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, JVM-side."""
    cross = F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: F.get(ring, i - 1)["x"] * F.get(ring, i)["y"] - F.get(ring, i)["x"] * F.get(ring, i - 1)["y"],
    )
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2


def polygon_area(rings: Column) -> Column:
    areas = F.transform(rings, ring_area)
    return 2 * F.get(areas, F.lit(0)) - F.aggregate(areas, F.lit(0.0), lambda acc, v: acc + v)


def signed_ring_area(ring: Column) -> Column:
    """Shoelace sum of a closed ring: positive where it runs counter-clockwise."""
    cross = F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: F.get(ring, i - 1)["x"] * F.get(ring, i)["y"] - F.get(ring, i)["x"] * F.get(ring, i - 1)["y"],
    )
    return F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v) / 2


def directed_edges(polygons: DataFrame, site: str, rings: str) -> DataFrame:
    """(site, xa, ya, xb, yb, weight): weight is 1 or -1, so that weighted integrals of y over the edges add up to
    the area of outer rings less that of holes, whichever way the rings run."""
    each = polygons.select(site, F.posexplode(rings).alias("ring_no", "ring"))
    closed = each.withColumn("ring", F.concat("ring", F.array(F.get("ring", F.lit(0)))))
    outer = F.when(F.col("ring_no") == 0, 1.0).otherwise(-1.0)
    weighed = closed.withColumn("weight", -F.signum(signed_ring_area(F.col("ring"))) * outer)
    steps = weighed.select(site, "weight", "ring", F.explode(F.sequence(F.lit(1), F.size("ring") - 1)).alias("k"))
    a, b = F.get("ring", F.col("k") - 1), F.get("ring", F.col("k"))
    return steps.select(site, "weight", a["x"].alias("xa"), a["y"].alias("ya"), b["x"].alias("xb"), b["y"].alias("yb")).where("xa <> xb")


def _between(t: Column, size: float) -> Column:
    """Antiderivative of ``t`` held between 0 and ``size``."""
    s = F.lit(size)
    return F.when(t <= 0, 0.0).when(t >= s, s * t - s * s / 2).otherwise(t * t / 2)


def edge_areas(edges: DataFrame, site: str, size: float) -> DataFrame:
    """(site, bx, by, area, below): what the edges crossing a cell add to its area, and the weighted width of the
    edge pieces whose lowest cell is the one just above.

    An edge is cut at the grid's columns; a piece touches the cells between its ends, and passes over all cells
    of its column further down, whose whole height lies below it.
    """
    low, high = F.least("xa", "xb"), F.greatest("xa", "xb")
    columns = edges.withColumn("bx", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    left, right = F.col("bx") * F.lit(size), (F.col("bx") + 1) * F.lit(size)
    slope = (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))

    def held(x: str) -> Column:
        return F.greatest(left, F.least(right, F.col(x)))

    def height(x: Column) -> Column:
        return F.when(x == F.col("xb"), F.col("yb")).otherwise(F.col("ya") + (x - F.col("xa")) * slope)

    pieces = columns.select(site, "bx", "weight", height(held("xa")).alias("y1"), height(held("xb")).alias("y2"), (held("xb") - held("xa")).alias("dx"))
    pieces = pieces.where("dx <> 0").withColumn("lowest", F.floor(F.least("y1", "y2") / size)).withColumn("highest", F.floor(F.greatest("y1", "y2") / size))
    touched = pieces.withColumn("by", F.explode(F.sequence("lowest", "highest")))
    base = F.col("by") * F.lit(size)
    u, v = F.col("y1") - base, F.col("y2") - base
    level = F.greatest(F.lit(0.0), F.least(F.lit(size), u))
    mean = F.when(u == v, level).otherwise((_between(v, size) - _between(u, size)) / F.nullif(v - u, F.lit(0.0)))
    crossed = touched.select(site, "bx", "by", (F.col("weight") * F.col("dx") * mean).alias("area"), F.lit(0.0).alias("below"))
    passed = pieces.select(site, "bx", (F.col("lowest") - 1).alias("by"), F.lit(0.0).alias("area"), (F.col("weight") * F.col("dx")).alias("below"))
    return crossed.unionByName(passed).groupBy(site, "bx", "by").agg(F.sum("area").alias("area"), F.sum("below").alias("below"))


def grid_overlay(polygons: DataFrame, cells: DataFrame, site: str, rings: str, size: float, smallest: float = 1e-9) -> DataFrame:
    """Site x cell intersection areas, weights and coverage; parts of a site add up.

    ``cells``: cell, x_min, x_max, y_min, y_max of a regular grid of step ``size``; its lines run through the
    smallest corner. Edges alone are cut and summed, in built-in expressions: a site's rings are never copied per
    cell. The cells between the edges of a column follow from a running sum down the column. Areas under
    ``smallest`` of a cell are rounding and left out.
    """
    left, bottom = (cells.agg(F.min(c)).scalar() for c in ("x_min", "y_min"))
    edges = directed_edges(polygons, site, rings).withColumns(
        {"xa": F.col("xa") - left, "xb": F.col("xb") - left, "ya": F.col("ya") - bottom, "yb": F.col("yb") - bottom}
    )
    sums = edge_areas(edges, site, size)
    boxed = with_box(polygons.select(site, rings), rings).drop(rings).withColumns(
        {c: F.col(c) - (left if c.startswith("x") else bottom) for c in BOX}
    )
    boxes = over_buckets(boxed, size).select(site, "bx", "by").distinct()
    spread = boxes.join(sums, [site, "bx", "by"], "full").fillna(0.0, ["area", "below"])
    # a site's column: as many rows as the site is cells high
    down = Window.partitionBy(site, "bx").orderBy(F.col("by").desc())
    area = F.col("area") + F.lit(size) * F.sum("below").over(down)
    placed = cells.select("cell", bucket((F.col("x_min") + F.col("x_max")) / 2 - left, size).alias("bx"), bucket((F.col("y_min") + F.col("y_max")) / 2 - bottom, size).alias("by"))
    cut = spread.select(site, "bx", "by", area.alias("intersection_area")).where(F.col("intersection_area") > smallest * size * size)
    kept = cut.join(placed, ["bx", "by"]).select(site, "cell", "intersection_area")
    areas = polygons.groupBy(site).agg(F.sum(polygon_area(F.col(rings))).alias("site_area"))
    covered = kept.groupBy(site).agg(F.sum("intersection_area").alias("covered_area"))
    return (
        kept.join(covered.join(areas, site), site)
        .withColumn("cell_weight", F.col("intersection_area") / F.col("covered_area"))
        .withColumn("coverage", F.col("covered_area") / F.col("site_area"))
    )


def all_sites_covered(polygons: DataFrame, overlay: DataFrame, site: str) -> DataFrame:
    """The overlay; reading it fails if a site has no cell at all."""
    missing = sites_without_cells(polygons, overlay, site).agg(F.count(F.lit(1))).scalar()
    known = F.when(missing == 0, F.col(site)).otherwise(F.raise_error(F.lit("sites without a grid cell")).cast("string"))
    return overlay.withColumn(site, known)


def sites_without_cells(polygons: DataFrame, overlay: DataFrame, site: str) -> DataFrame:
    return polygons.select(site).join(overlay.select(site).distinct(), site, "left_anti")
