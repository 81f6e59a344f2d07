"""Boxes and quadrilaterals as expressions. A box is x1, y1, x2, y2; a quadrilateral is a list of four (x, y)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
Quad = list[tuple[Column, Column]]


def bbox_iou(a: Box, b: Box) -> Column:
    """0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def quad_area(q: Quad) -> Column:
    terms = [q[i][0] * q[(i + 1) % 4][1] - q[(i + 1) % 4][0] * q[i][1] for i in range(4)]
    return F.abs(reduce(lambda a, b: a + b, terms)) / 2


def is_simple_quad(q: Quad) -> Column:
    """All non-zero turns go one way; without any, false."""
    turn = []
    for i in range(4):
        (ax, ay), (bx, by), (cx, cy) = q[i], q[(i + 1) % 4], q[(i + 2) % 4]
        turn.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    low, high = F.least(*turn), F.greatest(*turn)
    return ((low >= 0) & (high > 0)) | ((high <= 0) & (low < 0))


def long_edge_angle(q: Quad) -> Column:
    """Degrees of the first longest edge, in [-90, 90)."""
    edges = [F.struct((F.hypot(q[(i + 1) % 4][0] - q[i][0], q[(i + 1) % 4][1] - q[i][1])).alias("l"), F.lit(-i).alias("i"), F.degrees(F.atan2(q[(i + 1) % 4][1] - q[i][1], q[(i + 1) % 4][0] - q[i][0])).alias("a")) for i in range(4)]
    angle = F.array_max(F.array(*edges))["a"]
    return F.when(angle >= 90, angle - 180).when(angle < -90, angle + 180).otherwise(angle)


def is_axis_aligned(angle: Column, within: float = 3.0) -> Column:
    return (F.abs(angle) < within) | (F.abs(F.abs(angle) - 90) < within)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clamp_bbox(b: Box, width: Column, height: Column) -> list[Column]:
    """Rounded half-even, inside the image, one pixel wide and high at least."""
    r = [F.bround(x, 0).cast("int") for x in b]
    x1, y1 = F.greatest(F.lit(0), F.least(r[0], width - 1)), F.greatest(F.lit(0), F.least(r[1], height - 1))
    return [x1, y1, F.greatest(x1 + 1, F.least(r[2], width)), F.greatest(y1 + 1, F.least(r[3], height))]


def padding_per_axis(w: Column, h: Column, ratio: float = 0.4, least: int = 30, most: int = 80) -> list[Column]:
    return [F.greatest(F.lit(least), F.least((x * ratio).cast("int"), F.lit(most))) for x in (w, h)]


def padding_by_aspect(w: Column, h: Column, threshold: float = 1.5, square: float = 0.6, ratio: float = 0.4, least: int = 30, most: int = 80) -> Column:
    """struct(pad_x, pad_y, aspect, strategy): near-square boxes are padded alike on both axes."""
    long = F.greatest(w, h)
    aspect = long / F.greatest(F.least(w, h), F.lit(1.0))
    even = F.greatest(F.lit(least), F.least((long * square).cast("int"), F.lit(most)))
    px, py = padding_per_axis(w, h, ratio, least, most)
    near = aspect < threshold
    return F.struct(F.when(near, even).otherwise(px).alias("pad_x"), F.when(near, even).otherwise(py).alias("pad_y"), aspect.alias("aspect"), F.when(near, "square_diagonal").otherwise("per_axis").alias("strategy"))


def bbox_issues(cls: Column, cx: Column, cy: Column, w: Column, h: Column, classes: int) -> Column:
    """Names of the rules that a normalised centre box breaks."""
    return F.array_compact(F.array(
        F.when((cls < 0) | (cls >= classes), "class_out_of_range"), F.when((cx < 0) | (cx > 1) | (cy < 0) | (cy > 1), "center_out_of_range"),
        F.when((w <= 0) | (w > 1), "width_out_of_range"), F.when((h <= 0) | (h > 1), "height_out_of_range"),
    ))


def order_points(q: Quad) -> Column:
    """Points by angle about the centroid, from the one with the least x + y on."""
    cx, cy = sum((p[0] for p in q[1:]), q[0][0]) / 4, sum((p[1] for p in q[1:]), q[0][1]) / 4
    points = F.array_sort(F.array(*(F.struct(F.atan2(y - cy, x - cx).alias("a"), F.lit(i).alias("i"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(q))))
    sums = F.transform(points, lambda p: p["x"] + p["y"])
    start = F.array_position(sums, F.array_min(sums)).cast("int")
    return F.transform(F.concat(F.slice(points, start, F.lit(4)), F.slice(points, F.lit(1), start - 1)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def edge_angle(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Degrees of an edge in [-90, 90), two decimals."""
    return F.round(F.pmod(F.degrees(F.atan2(b[1] - a[1], b[0] - a[0])) + 90, F.lit(180.0)) - 90, 2)


def corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Quad:
    """Corners of a rotated box (radians), clockwise from the top left."""
    out = []
    for sx, sy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
        x, y = w * sx, h * sy
        out.append((cx + x * F.cos(angle) - y * F.sin(angle), cy + x * F.sin(angle) + y * F.cos(angle)))
    return out


def scale_points(points: Column, factor: Column) -> Column:
    """``x,y;x,y`` scaled, two decimals; pairs that are not two numbers are dropped."""
    pair = F.transform(F.split(points, ";"), lambda p: F.transform(F.split(p, ","), lambda v: v.try_cast("double")))
    good = F.filter(pair, lambda p: (F.size(p) == 2) & ~F.exists(p, lambda v: v.isNull()))
    return F.array_join(F.transform(good, lambda p: F.array_join(F.transform(p, lambda v: F.format_string("%.2f", v * factor)), ",")), ";")


def upright_size(q: Quad) -> Column:
    """struct(width, height) of a quadrilateral set upright: means of opposite edges, rounded half to even, 1 at least."""
    p = order_points(q)
    edge = lambda i, j: F.sqrt(F.pow(p[j]["x"] - p[i]["x"], 2) + F.pow(p[j]["y"] - p[i]["y"], 2))
    size = lambda a, b: F.greatest(F.lit(1), F.rint((a + b) / 2).cast("int"))
    return F.struct(size(edge(0, 1), edge(3, 2)).alias("width"), size(edge(0, 3), edge(1, 2)).alias("height"))


def large_enough(w: Column, h: Column, area: float = 100.0, side: float = 5.0) -> Column:
    """Crops that are kept: an area and sides of these sizes at least."""
    return F.coalesce((w * h >= area) & (F.least(w, h) >= side), F.lit(False))
