"""Pictures of scenes: one panel for each slot, one canvas for all events, and the frames of a film. Each scene or frame is one row of work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, media, raster
from ..sources import codecs
from ..sources.config import Config
from . import dataset

#: Fixed value: what scene seeds are mixed with for the corner that an arrow starts from.
CORNER_SALT = 0xC0DE_F00D_5EED_CAFE


def panels(seed: Column, slots: int, resolution: int, scatter: bool = False) -> Column:
    """Where the panel of each slot stands: array, by slot, of struct<x, y, corner>.

    Slots are dealt over the grid in the order of a hash of seed and slot, never in their own order if there are more than one. Scattered panels are
    moved by less than a third of the gap. corner (0 to 3) is where arrows from slot to slot begin and end.
    """
    parts = media.layout(F.lit(slots), resolution)
    gutter, step = parts["gutter"], parts["thumb"] + parts["gutter"]
    drawn = lambda slot, tag, n: identity.unsigned_mod(identity.splitmix64(seed.cast("bigint").bitwiseXOR(F.lit(tag << 32).cast("bigint")).bitwiseXOR(slot.cast("bigint"))), n)
    every = F.sequence(F.lit(0), F.lit(slots - 1)) if slots else F.array().cast("array<int>")
    order = F.transform(F.array_sort(F.transform(every, lambda s: F.struct(drawn(s, 1, F.lit(1 << 40)).alias("h"), s.alias("slot")))), lambda x: x["slot"])
    bound = lambda value, body: F.transform(F.array(value), body)[0]
    apart = bound(order, lambda o: F.when(o == every, F.concat(F.slice(o, 2, slots), F.slice(o, 1, 1))).otherwise(o))
    jitter = F.floor(gutter / 3) if scatter else F.lit(0)
    moved = lambda s, tag: F.when(jitter > 0, drawn(s, tag, F.greatest(jitter, F.lit(1)))).otherwise(F.lit(0))

    def placed(o: Column) -> Column:
        def one(s: Column) -> Column:
            at = F.array_position(o, s) - 1
            x, y = (at % parts["cols"]) * step + gutter + moved(s, 2), F.floor(at / parts["cols"]) * step + gutter + moved(s, 3)
            corner = (identity.unsigned_mod(identity.splitmix64(identity.wrapping_mul(seed.cast("bigint"), CORNER_SALT).bitwiseXOR(s.cast("bigint"))), F.lit(4)) + s % 4) % 4
            return F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), corner.cast("bigint").alias("corner"))

        return F.transform(every, one)

    return bound(apart, placed)


def _events(row) -> list[dict]:
    """A scene's events with their ends and their shape, in list order."""
    who = {s["shape_index"]: s for s in row.identities}
    ways = {(w["shape_index"], w["segment"]): w for w in row.waypoints}
    out = []
    for e in sorted(row.events, key=lambda e: e["list_pos"]):
        w, s = ways[e["shape_index"], e["shape_event_index"]], who[e["shape_index"]]
        out.append({"slot": e["time_slot"], "a": (w["x0"], w["y0"]), "b": (w["x1"], w["y1"]), "shape": s["shape_type"], "colour": media.RGB.get(s["color"], media.GREY)})
    return out


def _inverse(colour) -> tuple:
    return tuple(255 - c for c in colour)


def comic(events: list[dict], places: list[dict], thumb: int, gutter: int, cols: int, rows: int, arrows: str) -> np.ndarray:
    """The picture of a scene: a panel for each slot with the motions in it, and arrows from slot to slot (prev, next) or along each motion (current)."""
    image = raster.canvas(cols * thumb + (cols + 1) * gutter, rows * thumb + (rows + 1) * gutter)
    pad = max(thumb // 10, 1)
    inner = max(thumb - 2 * pad, 1)
    base = max(inner // 20, 5)
    in_slot: list[list[dict]] = [[] for _ in places]
    for e in events:
        p = places[e["slot"]]
        a, b = ((p["x"] + pad + x, p["y"] + pad + y) for x, y in (raster.pixel(*e["a"], inner), raster.pixel(*e["b"], inner)))
        in_slot[e["slot"]].append({**e, "from": a, "to": b, "radius": raster.radius_of(e["shape"], base)})
    for p in places:
        low, high = (p["x"], p["y"]), (p["x"] + thumb - 1, p["y"] + thumb - 1)
        raster.line(image, high, low, raster.GUIDE)
        raster.line(image, (low[0], high[1]), (high[0], low[1]), raster.GUIDE)
        raster.frame(image, low, high, raster.BLACK, raster.STROKE)
    inset = raster.half_up(thumb * 0.10)
    far = thumb - inset - 1
    anchors = [(p["x"] + (far if p["corner"] % 2 else inset), p["y"] + (far if p["corner"] >= 2 else inset)) for p in places]
    if arrows == "current":
        for e in (e for some in in_slot for e in some):
            raster.arrow(image, e["from"], raster.short_of(e["from"], e["to"], max(e["radius"] + 3, 1)))
    else:
        links = [*zip(anchors, anchors[1:])]
        for a, b in links if arrows == "prev" else reversed(links):
            raster.arrow(image, a, b)
    for p, some in zip(places, in_slot):
        for e in some:
            raster.line(image, e["from"], e["to"], e["colour"], raster.STROKE)
        for e in some:
            raster.filled(image, e["shape"], e["to"], e["radius"], e["colour"])
        for e in some:
            raster.outlined(image, e["shape"], e["to"], e["radius"])
        low, high = (p["x"], p["y"]), (p["x"] + thumb - 1, p["y"] + thumb - 1)
        middle = (low[0] + high[0]) // 2, (low[1] + high[1]) // 2
        raster.cross(image, low, high, middle, raster.BLACK, raster.STROKE)
        for e in some:
            raster.ring(image, e["to"], 1, _inverse(e["colour"]))
        raster.cross(image, low, high, middle, raster.RED, raster.OVERLAY)
    return image


def comics(of: DataFrame, config: Config) -> DataFrame:
    """(scene_index, png): each scene's picture of panels; a scene's row is drawn where it lies, without a shuffle."""
    scene = config["scene"]
    slots = scene["n_motion_slots"]
    cols, rows, thumb, gutter = (c.cast("int") for c in media.layout(F.lit(slots), scene["resolution"]).values())
    seed = F.col("scene_index") + F.lit(config["master_seed"])
    places = panels(seed, slots, scene["resolution"], scene["image_frame_scatter"])
    grid = F.struct(thumb.alias("thumb"), gutter.alias("gutter"), cols.alias("cols"), rows.alias("rows"))
    rows_ = of.select("scene_index", "identities", "waypoints", "events", places.alias("places"), grid.alias("grid"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pngs = [codecs.write_png(comic(_events(r), [*r.places], r.grid["thumb"], r.grid["gutter"], r.grid["cols"], r.grid["rows"], scene["image_arrow_type"])) for r in f.itertuples()]
            yield pd.DataFrame({"scene_index": f["scene_index"], "png": pngs})

    return rows_.mapInPandas(draw, "scene_index bigint, png binary")


def canvases(of: DataFrame, config: Config, resolution: int | None = None) -> DataFrame:
    """(scene_index, png): one canvas with axes, each event's way as a line, and its shape at the end."""
    size = resolution or config["scene.resolution"]

    def one(events: list[dict]) -> np.ndarray:
        image = raster.canvas(size, size)
        raster.cross(image, (0, 0), (size - 1, size - 1), (size // 2, size // 2), raster.BLACK, raster.STROKE)
        for e in events:
            a, b, radius = raster.pixel(*e["a"], size), raster.pixel(*e["b"], size), raster.radius_of(e["shape"], max(size // 64, 5))
            raster.line(image, a, b, e["colour"], raster.STROKE)
            raster.filled(image, e["shape"], b, radius, e["colour"])
            raster.outlined(image, e["shape"], b, radius)
        return image

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"scene_index": f["scene_index"], "png": [codecs.write_png(one(_events(r))) for r in f.itertuples()]})

    return of.select("scene_index", "identities", "waypoints", "events").mapInPandas(draw, "scene_index bigint, png binary")


def still(shapes: list[tuple[str, tuple, float, float]], size: int, key: bool) -> np.ndarray:
    """One frame of a film: (shape, colour, x, y) in the order of shapes; the last frame of a slot may have a border."""
    image = raster.canvas(size, size)
    last, middle = size - 1, size // 2
    raster.line(image, (0, 0), (last, last), raster.GUIDE)
    raster.line(image, (0, last), (last, 0), raster.GUIDE)
    placed = [(shape, colour, raster.pixel(x, y, size), raster.radius_of(shape, max(size // 64, 5))) for shape, colour, x, y in shapes]
    for shape, colour, at, radius in placed:
        raster.filled(image, shape, at, radius, colour)
        raster.outlined(image, shape, at, radius)
    raster.cross(image, (0, 0), (last, last), (middle, middle), raster.BLACK, raster.STROKE)
    for _, colour, at, _ in placed:
        raster.ring(image, at, 1, _inverse(colour))
    raster.cross(image, (0, 0), (last, last), (middle, middle), raster.RED, raster.OVERLAY)
    if key:
        for i in range(min(max(size * 3 // 100, 1), size)):
            raster.frame(image, (i, i), (last - i, last - i), raster.BORDER, 1)
    return image


def films(of: DataFrame, config: Config) -> DataFrame:
    """(scene_index, frame, png): the frames of each scene in order; none for scenes without events."""
    scene = config["scene"]
    size, n, border = scene["resolution"], scene["event_duration_frames"], scene["video_keyframe_border"]
    who = of.select("scene_index", F.explode("identities").alias("s")).select("scene_index", F.col("s.shape_index").alias("shape_index"), F.col("s.shape_type").alias("shape"), F.col("s.color").alias("colour"))
    at = dataset.frames(of, config).join(who, ["scene_index", "shape_index"])
    drawn = F.array_sort(F.collect_list(F.struct("shape_index", "shape", "colour", "x", "y"))).alias("shapes")
    rows = at.groupBy("scene_index", (F.col("time_slot") * n + F.col("frame")).alias("frame")).agg(drawn)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pngs = [codecs.write_png(still([(s["shape"], media.RGB.get(s["colour"], media.GREY), s["x"], s["y"]) for s in r.shapes], size, border and r.frame % n == n - 1)) for r in f.itertuples()]
            yield pd.DataFrame({"scene_index": f["scene_index"], "frame": f["frame"], "png": pngs})

    return rows.mapInPandas(draw, "scene_index bigint, frame bigint, png binary")
