"""Drawing on arrays of pixels (height x width x 3 bytes); what falls outside is cut off. Coordinates are whole pixels, y downwards."""

from __future__ import annotations

import math

import numpy as np

#: Colours and widths of strokes, in pixels.
WHITE, BLACK, RED, GUIDE, BORDER = (255, 255, 255), (0, 0, 0), (255, 0, 0), (220, 220, 220), (220, 20, 60)
STROKE, OVERLAY, OUTLINE = 4, 1, 1
#: Corners of a star beside its tips; an arrow's head as least size, times its stroke, and share of its length.
STAR_INNER, HEAD_LEAST, HEAD_TIMES, HEAD_SHARE, SHAFT = 0.45, 12.0, 4.5, 0.45, 0.82
#: Corners of the regular shapes and the angle of the first, in units of pi.
CORNERS = {"triangle": (3, -0.5), "square": (4, 0.25), "pentagon": (5, -0.5), "hexagon": (6, -0.5)}

Point = tuple[int, int]


def canvas(width: int, height: int) -> np.ndarray:
    return np.full((height, width, 3), 255, np.uint8)


def half_up(v: float) -> int:
    """The nearest whole number, halves away from zero."""
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def pixel(x: float, y: float, size: int) -> Point:
    """Where a point of the square from -1 to 1 stands in a picture of `size` pixels; y points up there."""
    at = lambda v: min(max(half_up(v * (size - 1)), 0), size - 1)
    return at((x + 1) * 0.5), at(1 - (y + 1) * 0.5)


def put(image: np.ndarray, x: np.ndarray, y: np.ndarray, colour) -> None:
    there = (x >= 0) & (y >= 0) & (x < image.shape[1]) & (y < image.shape[0])
    image[y[there], x[there]] = colour


def on_line(a: Point, b: Point) -> tuple[np.ndarray, np.ndarray]:
    """The pixels of a thin line, by whole-number error terms."""
    (x, y), (dx, dy) = a, (abs(b[0] - a[0]), -abs(b[1] - a[1]))
    sx, sy = (1 if a[0] < b[0] else -1), (1 if a[1] < b[1] else -1)
    xs, ys, error = [x], [y], dx + dy
    while (x, y) != b:
        twice = 2 * error
        if twice >= dy:
            error, x = error + dy, x + sx
        if twice <= dx:
            error, y = error + dx, y + sy
        xs.append(x)
        ys.append(y)
    return np.array(xs), np.array(ys)


def line(image: np.ndarray, a: Point, b: Point, colour, stroke: int = 1) -> None:
    """A line as wide as a disc of half the stroke that is moved along it."""
    half = max(stroke, 1) // 2
    dy, dx = np.mgrid[-half : half + 1, -half : half + 1]
    disc = dx * dx + dy * dy <= half * half
    x, y = on_line(a, b)
    put(image, (x[:, None] + dx[disc]).ravel(), (y[:, None] + dy[disc]).ravel(), colour)


def polygon(image: np.ndarray, corners: list[Point], colour) -> None:
    """Fill a polygon: pixels with an odd number of edges to the right of them; an edge's place in a row is cut towards zero from its start."""
    if len(corners) < 3:
        return
    px, py = np.array(corners).T
    y, x = np.mgrid[py.min() : py.max() + 1, px.min() : px.max() + 1]
    inside = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(corners, [corners[-1], *corners[:-1]]):
        if ay != by:
            ahead = (bx - ax) * (y - ay)
            cross = np.sign(ahead) * np.sign(by - ay) * (np.abs(ahead) // abs(by - ay)) + ax
            inside ^= ((ay > y) != (by > y)) & (x < cross)
    put(image, x[inside], y[inside], colour)


def ring(image: np.ndarray, centre: Point, radius: int, colour, stroke: int | None = None) -> None:
    """A disc; with a stroke only its edge of that width."""
    outer = radius if stroke is None else max(radius, 1)
    dy, dx = np.mgrid[-outer : outer + 1, -outer : outer + 1]
    far = dx * dx + dy * dy
    inner = -1 if stroke is None else max(outer - max(stroke, 1), 0) ** 2
    on = (far <= outer * outer) & (far >= inner)
    put(image, centre[0] + dx[on], centre[1] + dy[on], colour)


def corners_of(shape: str, centre: Point, radius: int) -> list[Point]:
    """The corners of a shape; none for round ones."""
    if shape == "star":
        turns = [(-0.5 + i / 5, radius * (1.0 if i % 2 == 0 else STAR_INNER)) for i in range(10)]
    elif shape in CORNERS:
        n, first = CORNERS[shape]
        turns = [(first + 2 * i / n, float(radius)) for i in range(n)]
    else:
        return []
    return [(half_up(centre[0] + r * math.cos(math.pi * t)), half_up(centre[1] + r * math.sin(math.pi * t))) for t, r in turns]


def filled(image: np.ndarray, shape: str, centre: Point, radius: int, colour) -> None:
    corners = corners_of(shape, centre, radius)
    if corners:
        polygon(image, corners, colour)
    else:
        ring(image, centre, radius, colour)


def outlined(image: np.ndarray, shape: str, centre: Point, radius: int) -> None:
    corners = corners_of(shape, centre, radius)
    for a, b in zip(corners, corners[1:] + corners[:1]):
        line(image, a, b, BLACK, OUTLINE)
    if not corners:
        ring(image, centre, radius, BLACK, OUTLINE)


def arrow(image: np.ndarray, a: Point, b: Point, colour=BLACK, stroke: int = STROKE) -> None:
    """A line with a white head that is outlined; nothing if it has no length."""
    length = math.hypot(b[0] - a[0], b[1] - a[1])
    if length == 0:
        return
    ux, uy = (b[0] - a[0]) / length, (b[1] - a[1]) / length
    head = min(max(max(stroke, 1) * HEAD_TIMES, HEAD_LEAST), length * HEAD_SHARE)
    c, s = math.cos(math.pi / 6), math.sin(math.pi / 6)
    back = lambda vx, vy, far: (half_up(b[0] - far * vx), half_up(b[1] - far * vy))
    tips = [b, back(ux * c - uy * s, ux * s + uy * c, head), back(ux * c + uy * s, uy * c - ux * s, head)]
    line(image, a, back(ux, uy, head * SHAFT), colour, stroke)
    polygon(image, tips, WHITE)
    for p, q in zip(tips, tips[1:] + tips[:1]):
        line(image, p, q, colour, stroke)


def short_of(a: Point, b: Point, gap: float) -> Point:
    """The point on the way from a to b that is `gap` before b; b itself if they are nearer than that."""
    length = math.hypot(b[0] - a[0], b[1] - a[1])
    if length <= gap or length == 0:
        return b
    part = (length - gap) / length
    return half_up(a[0] + (b[0] - a[0]) * part), half_up(a[1] + (b[1] - a[1]) * part)


def cross(image: np.ndarray, low: Point, high: Point, middle: Point, colour, stroke: int) -> None:
    """Axes through the middle of a box."""
    line(image, (low[0], middle[1]), (high[0], middle[1]), colour, stroke)
    line(image, (middle[0], low[1]), (middle[0], high[1]), colour, stroke)


def frame(image: np.ndarray, low: Point, high: Point, colour, stroke: int) -> None:
    """The four edges of a box."""
    corners = [low, (high[0], low[1]), high, (low[0], high[1])]
    for a, b in ((0, 1), (3, 2), (0, 3), (1, 2)):
        line(image, corners[a], corners[b], colour, stroke)


def radius_of(shape: str, base: int) -> int:
    """How large the marker of a shape is drawn."""
    return {"triangle": (base * 3 + 1) // 2, "star": base * 2, "circle": base + 2}.get(shape, base + 1)
