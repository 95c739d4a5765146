"""Players: which detections can be one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlane.functions import geometry as G


def inner_quad(quad: list[str], inner: float = 0.02) -> list[str]:
    """The court's corners (eight expressions) with the two far ones moved towards the near ones by ``inner``, 0 to 0.25, of their sides."""
    r = min(0.25, max(0.0, inner))
    x0, y0, x1, y1, x2, y2, x3, y3 = quad
    part = lambda a, b: f"({a} + {r} * ({b} - {a}))"
    return [part(x0, x3), part(y0, y3), part(x1, x2), part(y1, y2), x2, y2, x3, y3]


def player_candidates(detections: DataFrame, quad: list[str], least_w: float = 10.0, least_h: float = 20.0, inner: float = 0.02, keep: float = 100.0) -> DataFrame:
    """Detections (b0..b3 the box, fx and fy the foot) that can be a player: a box of ``least_w`` x ``least_h`` px, the foot in the court's ``quad`` and in its inner quadrilateral.
    Outside the inner one a foot is excused within ``keep`` px of where the far player was, if the table has far_x and far_y."""
    box = (F.col("b2") - F.col("b0") >= least_w) & (F.col("b3") - F.col("b1") >= least_h)
    inside = F.expr(G.in_quad("fx", "fy", inner_quad(quad, inner)))
    if {"far_x", "far_y"} <= set(detections.columns):
        inside = inside | F.coalesce(F.sqrt((F.col("fx") - F.col("far_x")) ** 2 + (F.col("fy") - F.col("far_y")) ** 2) <= keep, F.lit(False))
    return detections.where(box & F.expr(G.in_quad("fx", "fy", quad)) & inside)
