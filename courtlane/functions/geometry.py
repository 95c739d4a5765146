"""Court geometry as SQL expressions (text in, text out): they run inside Spark's generated code by F.expr, and read the same in any ANSI engine.

Coordinates of the picture are pixels, those of the court metres: x from 0 to 6.10 across, y from 0 (far base line) to 13.40.
"""

from __future__ import annotations

COURT_W, COURT_L = 6.10, 13.40


def case(*pairs: tuple[str, str], other: str = "NULL") -> str:
    return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END)"


def clip(v: str, lo: str | float, hi: str | float) -> str:
    return f"least({hi}, greatest({lo}, {v}))"


def dist(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt((({ax}) - ({bx})) * (({ax}) - ({bx})) + (({ay}) - ({by})) * (({ay}) - ({by})))"


def project(x: str, y: str) -> tuple[str, str]:
    """Pixel to court metres by h11..h33; null where the denominator is within 1e-9 of zero."""
    w = f"(h31 * ({x}) + h32 * ({y}) + h33)"
    return tuple(case((f"abs({w}) > 1e-9", f"({a} * ({x}) + {b} * ({y}) + {c}) / {w}")) for a, b, c in (("h11", "h12", "h13"), ("h21", "h22", "h23")))


def homography(quad: list[str]) -> list[dict[str, str]]:
    """Entries h11..h33 of the homography from the corners TL, TR, BR, BL (eight expressions) to the court, scaled to h33 = 1, as three
    stages of columns, each over those before it.

    The map of the unit square to a quadrilateral has a closed form; its adjugate is the inverse up to scale. Null for a quadrilateral of less
    than 64 square pixels or a determinant within 1e-12 of zero.
    """
    x0, y0, x1, y1, x2, y2, x3, y3 = quad
    dx1, dx2, sx = f"({x1} - {x2})", f"({x3} - {x2})", f"({x0} - {x1} + {x2} - {x3})"
    dy1, dy2, sy = f"({y1} - {y2})", f"({y3} - {y2})", f"({y0} - {y1} + {y2} - {y3})"
    den = f"nullif({dx1} * {dy2} - {dx2} * {dy1}, 0)"
    first = {"pg": f"({sx} * {dy2} - {dx2} * {sy}) / {den}", "ph": f"({dx1} * {sy} - {sx} * {dy1}) / {den}"}
    second = {"pa": f"{x1} - {x0} + pg * {x1}", "pb": f"{x3} - {x0} + ph * {x3}", "pc": x0, "pd": f"{y1} - {y0} + pg * {y1}", "pe": f"{y3} - {y0} + ph * {y3}", "pf": y0}
    adj = [["pe - pf * ph", "pc * ph - pb", "pb * pf - pc * pe"], ["pf * pg - pd", "pa - pc * pg", "pc * pd - pa * pf"], ["pd * ph - pe * pg", "pb * pg - pa * ph", "pa * pe - pb * pd"]]
    good = f"abs({shoelace(quad)}) >= 64 AND abs(pa * ({adj[0][0]}) + pb * ({adj[1][0]}) + pc * ({adj[2][0]})) > 1e-12"
    scale = [COURT_W, COURT_L, 1.0]
    return [first, second, {f"h{i + 1}{j + 1}": case((good, f"{scale[i]} * ({adj[i][j]}) / nullif({adj[2][2]}, 0)")) for i in range(3) for j in range(3)}]


def shoelace(quad: list[str]) -> str:
    """Signed area of a quadrilateral."""
    p = [(quad[i], quad[i + 1]) for i in range(0, 8, 2)]
    return "(0.5 * (" + " + ".join(f"({p[i][0]} * {p[(i + 1) % 4][1]} - {p[(i + 1) % 4][0]} * {p[i][1]})" for i in range(4)) + "))"


def expanded_quad(quad: list[str], far: float, near: float, side: float) -> list[str]:
    """The quadrilateral with its far edge moved up and its near edge moved down along the court's axis, and its sides moved out."""
    x0, y0, x1, y1, x2, y2, x3, y3 = quad
    fx, fy, nx, ny = f"(({x0} + {x1}) / 2)", f"(({y0} + {y1}) / 2)", f"(({x2} + {x3}) / 2)", f"(({y2} + {y3}) / 2)"
    n = f"greatest({dist(fx, fy, nx, ny)}, 1e-6)"
    ux, uy = f"(({fx} - {nx}) / {n})", f"(({fy} - {ny}) / {n})"
    return [f"({x0} + {far} * {ux} - {side})", f"({y0} + {far} * {uy})", f"({x1} + {far} * {ux} + {side})", f"({y1} + {far} * {uy})", f"({x2} - {near} * {ux} + {side})", f"({y2} - {near} * {uy})", f"({x3} - {near} * {ux} - {side})", f"({y3} - {near} * {uy})"]


def crosses(x: str, y: str, quad: list[str]) -> list[str]:
    p = [(quad[i], quad[i + 1]) for i in range(0, 8, 2)]
    return [f"(({p[(i + 1) % 4][0]} - {p[i][0]}) * (({y}) - {p[i][1]}) - ({p[(i + 1) % 4][1]} - {p[i][1]}) * (({x}) - {p[i][0]}))" for i in range(4)]


def in_quad(x: str, y: str, quad: list[str], eps: float = 1e-4) -> str:
    """Whether a point is in a convex quadrilateral, its edge included: all four cross products have one sign."""
    c = crosses(x, y, quad)
    return f"(({' AND '.join(f'{v} >= -{eps}' for v in c)}) OR ({' AND '.join(f'{v} <= {eps}' for v in c)}))"


def edge_corridor(x: str, y: str, quad: list[str], across: float = 18, aside: float = 40) -> str:
    """Whether a point lies near the line of the top edge: at most ``across`` px off it and ``aside`` px beyond its ends."""
    x0, y0, x1, y1 = quad[:4]
    n = f"greatest({dist(x0, y0, x1, y1)}, 1e-6)"
    off = f"abs((({x1} - {x0}) * (({y}) - {y0}) - ({y1} - {y0}) * (({x}) - {x0})) / {n})"
    along = f"((({x}) - {x0}) * ({x1} - {x0}) + (({y}) - {y0}) * ({y1} - {y0})) / {n}"
    return f"({off} <= {across} AND {along} BETWEEN -{aside} AND {n} + {aside})"


def closest_on_segment(x: str, y: str, ax: str, ay: str, bx: str, by: str) -> tuple[str, str]:
    t = clip(f"((({x}) - {ax}) * ({bx} - {ax}) + (({y}) - {ay}) * ({by} - {ay})) / greatest(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}), 1e-9)", 0, 1)
    return f"({ax} + ({t}) * ({bx} - {ax}))", f"({ay} + ({t}) * ({by} - {ay}))"


def metres_per_pixel(x: str, y: str, floor_y: float, most: float = 0.055) -> str:
    """Larger of the two local scales of the homography (one pixel across, one down), taken at ``floor_y`` or below and capped."""
    yy = f"greatest({y}, {floor_y})"
    (a, b), (c, d), (e, f) = project(x, yy), project(f"({x}) + 1", yy), project(x, f"{yy} + 1")
    return f"least({most}, greatest({dist(c, d, a, b)}, {dist(e, f, a, b)}))"


def line_distance(x: str, y: str) -> str:
    """Signed distance to the court's outline in metres: positive inside."""
    inside = f"least(least({x}, {COURT_W} - ({x})), least({y}, {COURT_L} - ({y})))"
    ox, oy = f"greatest(greatest(-({x}), ({x}) - {COURT_W}), 0)", f"greatest(greatest(-({y}), ({y}) - {COURT_L}), 0)"
    return case((f"({x}) IS NULL OR ({y}) IS NULL", "NULL"), (f"{inside} >= 0", inside), other=f"-sqrt({ox} * {ox} + {oy} * {oy})")


def line_call(distance: str, ambiguity: float = 0.20) -> str:
    return case((f"{distance} IS NULL", "NULL"), (f"abs({distance}) <= {ambiguity}", "'review'"), (f"{distance} > 0", "'in'"), other="'out'")


def boundary(x: str, y: str, beyond: float = 0.05) -> str:
    """The one edge that a point lies outside of by more than ``beyond`` metres; null for none or several."""
    out = {"left": f"({x}) < -{beyond}", "right": f"({x}) > {COURT_W} + {beyond}", "far": f"({y}) < -{beyond}", "near": f"({y}) > {COURT_L} + {beyond}"}
    count = " + ".join(f"CAST({c} AS INT)" for c in out.values())
    return case((f"({count}) <> 1", "NULL"), *[(c, f"'{n}'") for n, c in out.items()])


def half_court(side: str, y: str, stretch: float = 1.35, mid: float = COURT_L / 2) -> str:
    """y kept in the player's own half: a far player's is folded back over the net and stretched, a near player's is held beyond it."""
    folded = f"{mid} - abs({mid} - {clip(y, 0, COURT_L)})"
    return case((f"{side} = 'far'", clip(f"{mid} - ({mid} - ({folded})) * {stretch}", 0, mid)), (f"{side} = 'near'", f"greatest({clip(y, 0, COURT_L)}, {mid} + 1e-3)"))


def zone(own: str) -> str:
    """Zone by the distance to the own net in metres; the strips between zones are null."""
    return case((f"{own} <= 1.95", "'front'"), (f"{own} BETWEEN 2.45 AND 4.15", "'mid'"), (f"{own} >= 4.65", "'back'"))


def target_half(hitter: str, y: str, tolerance: float = 0.55, mid: float = COURT_L / 2) -> str:
    return case((f"{hitter} = 'far'", f"({y}) >= {mid} - {tolerance}"), (f"{hitter} = 'near'", f"({y}) <= {mid} + {tolerance}"))


def angle(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """Angle at b in degrees; null where an arm has no length."""
    n = f"({dist(ax, ay, bx, by)} * {dist(cx, cy, bx, by)})"
    dot = f"((({ax}) - ({bx})) * (({cx}) - ({bx})) + (({ay}) - ({by})) * (({cy}) - ({by})))"
    return case((f"{n} > 1e-9", f"degrees(acos({clip(f'{dot} / {n}', -1, 1)}))"))


def axis_separation(ax: str, ay: str, bx: str, by: str) -> str:
    """Angle between two directions as axes, 0 to 90 degrees."""
    raw = f"(abs(degrees(atan2({ay}, {ax}) - atan2({by}, {bx}))) % 180)"
    return f"least({raw}, 180 - {raw})"


def timecode(seconds: str) -> str:
    return f"concat(lpad(CAST(CAST(floor(({seconds}) / 60) AS BIGINT) AS VARCHAR(9)), 2, '0'), ':', lpad(CAST(CAST(floor({seconds}) AS BIGINT) % 60 AS VARCHAR(9)), 2, '0'))"


def orbit(t: str, radius: float, roll: float, zoom: float) -> dict[str, str]:
    """Where a camera stands on an orbit at ``t`` (0 to 1, held there): shift in pixels across and down, roll in degrees, and scale."""
    theta = f"(2 * pi() * {clip(t, 0, 1)})"
    return {"dx": f"{radius} * cos({theta})", "dy": f"{radius} * 0.42 * sin({theta})", "roll": f"{roll} * sin({theta})", "scale": f"1 + ({zoom} - 1) * (0.55 + 0.45 * sin({theta} + pi() * 0.5))"}
