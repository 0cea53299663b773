"""Rectangles (struct of left, top, right, bottom), polygons (array of struct x, y) and anchors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rect(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), right.cast("int").alias("right"), bottom.cast("int").alias("bottom"))


def normalize(r: Column) -> Column:
    """Left and top are the smaller coordinates."""
    return rect(F.least(r["left"], r["right"]), F.least(r["top"], r["bottom"]), F.greatest(r["left"], r["right"]), F.greatest(r["top"], r["bottom"]))


def width(r: Column) -> Column:
    return F.greatest(F.lit(0), r["right"] - r["left"])


def height(r: Column) -> Column:
    return F.greatest(F.lit(0), r["bottom"] - r["top"])


def pad_clip(r: Column, padding: int, size_x: Column, size_y: Column) -> Column:
    """Grown by the padding and cut at the image."""
    return rect(F.greatest(F.lit(0), r["left"] - padding), F.greatest(F.lit(0), r["top"] - padding), F.least(size_x, r["right"] + padding), F.least(size_y, r["bottom"] + padding))


def scale_rect(r: Column, sx: float, sy: float) -> Column:
    """Every coordinate scaled and rounded half to even, then normalized; scales within 0.001 of 1 change nothing."""
    if abs(sx - 1) < 0.001 and abs(sy - 1) < 0.001:
        return r
    return normalize(rect(F.bround(r["left"] * sx), F.bround(r["top"] * sy), F.bround(r["right"] * sx), F.bround(r["bottom"] * sy)))


def scale_points(points: Column, sx: float, sy: float) -> Column:
    if abs(sx - 1) < 0.001 and abs(sy - 1) < 0.001:
        return points
    return F.transform(points, lambda p: F.struct(F.bround(p["x"] * sx).cast("int").alias("x"), F.bround(p["y"] * sy).cast("int").alias("y")))


def scale_rect_preview(r: Column, sx: float, sy: float) -> Column:
    """Outward rounding, at least one pixel; empty stays empty and null stays null."""
    left, top = F.floor(r["left"] * sx), F.floor(r["top"] * sy)
    grown = rect(left, top, F.greatest(left + 1, F.ceil(r["right"] * sx)), F.greatest(top + 1, F.ceil(r["bottom"] * sy)))
    return F.when(r.isNull(), None).when((width(r) <= 0) | (height(r) <= 0), rect(left, top, left, top)).otherwise(grown)


def crop_box(points: Column, size_x: Column, size_y: Column) -> Column:
    """The bounding box of a polygon inside the image; right and bottom are one past the last pixel."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return rect(F.greatest(F.lit(0), F.array_min(xs)), F.greatest(F.lit(0), F.array_min(ys)), F.least(size_x, F.array_max(xs) + 1), F.least(size_y, F.array_max(ys) + 1))


#: Named anchors: share of the free room, and sign of the margin, for x and y.
ANCHORS = {
    "Top-Left": ((0, 1), (0, 1)), "Top-Center": ((1, 0), (0, 1)), "Top-Right": ((2, -1), (0, 1)),
    "Center-Left": ((0, 1), (1, 0)), "Center": ((1, 0), (1, 0)), "Center-Right": ((2, -1), (1, 0)),
    "Bottom-Left": ((0, 1), (2, -1)), "Bottom-Center": ((1, 0), (2, -1)), "Bottom-Right": ((2, -1), (2, -1)),
}


def anchor_position(canvas_w: Column, canvas_h: Column, item_w: Column, item_h: Column, anchor: Column, x_percent: Column, y_percent: Column, margin_x: int, margin_y: int) -> Column:
    """struct(x, y) of an item on a canvas: a named anchor, "Custom" by percent, anything else as Bottom-Right.

    The place is held inside the canvas; where the item is larger, 0 wins.
    """

    def along(free: Column, percent: Column, margin: int, axis: int) -> Column:
        def place(half: int, sign: int) -> Column:
            return F.floor(free * half / 2) + sign * margin

        out = F.when(anchor == "Custom", F.bround(free * percent / 100).cast("long"))
        for name, at in ANCHORS.items():
            out = out.when(anchor == name, place(*at[axis]))
        return F.greatest(F.lit(0), F.least(free, out.otherwise(place(2, -1)))).cast("int")

    return F.struct(along(canvas_w - item_w, x_percent, margin_x, 0).alias("x"), along(canvas_h - item_h, y_percent, margin_y, 1).alias("y"))


def in_ellipse(x: Column, y: Column, r: Column) -> Column:
    """Inside or on the ellipse in the box (integers only)."""
    w, h = (r["right"] - r["left"]).cast("long"), (r["bottom"] - r["top"]).cast("long")
    dx, dy = 2 * x - r["left"] - r["right"], 2 * y - r["top"] - r["bottom"]
    return (w > 0) & (h > 0) & (dx * dx * h * h + dy * dy * w * w <= w * w * h * h)


def in_rect(x: Column, y: Column, r: Column) -> Column:
    """Both ends belong to the rectangle; one without area holds nothing."""
    return (width(r) > 0) & (height(r) > 0) & x.between(r["left"], r["right"]) & y.between(r["top"], r["bottom"])


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule, with the edges inside; fewer than three points hold nothing."""
    n = F.size(points)
    edges = F.transform(points, lambda p, k: F.struct(p.alias("a"), F.element_at(points, (F.pmod(k + 1, n) + 1).cast("int")).alias("b")))
    long = lambda c: c.cast("long")

    def side(e: Column) -> Column:
        return long(e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - long(e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])

    on_edge = F.exists(edges, lambda e: (side(e) == 0) & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"])))
    crosses = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & ((side(e) > 0) == (e["b"]["y"] > e["a"]["y"])))
    return F.coalesce((n >= 3) & (on_edge | (F.size(crosses) % 2 == 1)), F.lit(False))
