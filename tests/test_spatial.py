"""Locating points and clipping polygons against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from biotope.operators import spatial

RINGS = "site string, rings array<array<struct<x:double,y:double>>>"


def star(cx, cy, r, n, seed):
    rng = np.random.default_rng(seed)
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = r * rng.uniform(0.5, 1.0, n)
    points = np.column_stack([cx + radius * np.cos(angle), cy + radius * np.sin(angle)])
    return np.vstack([points, points[:1]])


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def inside(points, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(points, points[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


@pytest.mark.parametrize(("most_edges", "sent"), [(1, 50_000), (5, 0), (16, 50_000), (1000, 50_000)])
def test_locate(spark, monkeypatch, most_edges, sent):
    """Coverings from very fine to one cell, sent to the points or met by salted cells."""
    monkeypatch.setattr(spatial, "SENT_CELLS", sent)
    outlines = {str(i): star(3 * i, 2 * i, 4, 23, i) for i in range(4)}
    hole = star(3, 2, 1, 9, 99)
    polygons = spark.createDataFrame(
        [(s, [ring(p), ring(hole)] if s == "1" else [ring(p)]) for s, p in outlines.items()], RINGS
    )
    rng = np.random.default_rng(5)
    xy = np.round(rng.uniform(-5, 14, size=(600, 2)), 1)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    got = spatial.locate(points, spatial.with_edges(polygons, "site", "rings"), "site", "x", "y", most_edges=most_edges).collect()
    assert len(got) == 600
    for row in got:
        hits = [s for s, p in outlines.items() if inside(p, row.x, row.y) and not (s == "1" and inside(hole, row.x, row.y))]
        assert row.site == (min(hits) if hits else None)


def test_covering_has_few_large_inner_cells_and_short_edge_lists(spark):
    """A fine outline of 5,000 edges: no cell keeps more edges than allowed, inner cells have none, and they grow with the outline, not the area."""
    angle = np.linspace(0, 2 * np.pi, 5000, endpoint=False)
    radius = 40 + np.random.default_rng(7).uniform(-0.02, 0.02, 5000)
    points = np.column_stack([50.3 + radius * np.cos(angle), 49.1 + radius * np.sin(angle)])
    outline = np.vstack([points, points[:1]])
    shapes = spatial.with_edges(spark.createDataFrame([("s", [ring(outline)])], RINGS), "site", "rings")
    cells, whole = spatial.cover(shapes, "site", 16)
    rows = cells.collect()
    assert max(len(r.edges) for r in rows) <= 16
    assert all(r.odd for r in rows if not r.edges)
    smallest = whole / 2 ** max(r.level for r in rows)
    assert len(rows) < (80 / smallest) ** 2 / 5
    inner = sum((whole / 2**r.level) ** 2 for r in rows if not r.edges)
    assert 0.9 * spatial_area(outline) < inner < spatial_area(outline)


def test_points_without_shapes(spark):
    shapes = spatial.with_edges(spark.createDataFrame([], RINGS), "site", "rings")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 1.0)], "id int, x double, y double")
    assert [r.site for r in spatial.locate(points, shapes, "site", "x", "y").collect()] == [None, None]


def test_overlay_of_stars_against_fine_grid(spark):
    shape, hole = star(0.3, -0.2, 3, 17, 2), [(-0.4, -0.6), (0.9, -0.5), (0.2, 0.8), (-0.4, -0.6)]
    for outer in (shape, shape[::-1]):
        polygons = spark.createDataFrame([("s", [ring(outer)[:], ring(hole)])], RINGS)
        cells = spark.createDataFrame(
            [(f"{i},{j}", float(i), i + 1.0, float(j), j + 1.0) for i in range(-5, 5) for j in range(-5, 5)],
            "cell string, x_min double, x_max double, y_min double, y_max double",
        )
        got = {r.cell: r.intersection_area for r in spatial.grid_overlay(polygons, cells, "site", "rings", 1.0).collect()}
        fine = (np.arange(40) + 0.5) / 40
        for i in range(-5, 5):
            for j in range(-5, 5):
                share = np.mean([inside(outer, i + x, j + y) and not inside(hole, i + x, j + y) for x in fine for y in fine])
                assert got.get(f"{i},{j}", 0.0) == pytest.approx(share, abs=0.03)
        assert sum(got.values()) == pytest.approx(spatial_area(outer) - spatial_area(hole))


def spatial_area(points):
    xy = np.array(points, dtype=float)
    return 0.5 * abs(float(np.dot(xy[:, 0], np.roll(xy[:, 1], -1)) - np.dot(xy[:, 1], np.roll(xy[:, 0], -1))))


def test_overlay_parts_and_missing_sites(spark):
    def box(x0, y0, x1, y1):
        return [ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])]

    polygons = spark.createDataFrame(
        [("a", box(0.5, 0.5, 1.5, 1.5)), ("a", box(2.0, 0.0, 3.0, 1.0)), ("b", box(90, 90, 91, 91))], RINGS
    )
    cells = spark.createDataFrame(
        [(f"{i},{j}", float(i), i + 1.0, float(j), j + 1.0) for i in range(4) for j in range(2)],
        "cell string, x_min double, x_max double, y_min double, y_max double",
    )
    overlay = spatial.grid_overlay(polygons, cells, "site", "rings", 1.0)
    rows = {r.cell: r for r in overlay.collect()}
    assert rows["2,0"].intersection_area == pytest.approx(1) and rows["2,0"].site_area == pytest.approx(2)
    assert rows["0,0"].cell_weight == pytest.approx(0.125) and rows["0,0"].coverage == pytest.approx(1)
    assert [r.site for r in spatial.sites_without_cells(polygons, overlay, "site").collect()] == ["b"]
    with pytest.raises(Exception, match="sites without a grid cell"):
        spatial.all_sites_covered(polygons, overlay, "site").collect()
    total = overlay.groupBy("site").agg(F.sum("cell_weight").alias("w")).head().w
    assert total == pytest.approx(1)
