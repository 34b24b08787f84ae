"""Sound and picture arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp

#: Sound.
BASE_HZ, CLASSES, PULSE_DUTY, PEAK_SHARE, I16_MAX = 220.0, 36, 0.25, 0.70, 32767
#: Colours as red, green, blue; any other name is dark grey.
RGB = {
    "red": (220, 20, 60), "green": (30, 160, 60), "blue": (30, 90, 220), "yellow": (230, 190, 40), "magenta": (180, 50, 170), "cyan": (20, 170, 190),
    "purple": (180, 50, 170), "orange": (230, 120, 20), "white": (200, 200, 200),
}
GREY = (60, 60, 60)


def pan(x: Column) -> tuple[Column, Column]:
    right = (clamp(x, -1.0, 1.0) + 1.0) * 0.5
    return 1.0 - right, right


def modulated(base: Column, at: Column, depth: Column | float) -> Column:
    """A frequency or an amplitude, changed in proportion to a coordinate."""
    return base * (F.lit(1.0) + F.lit(depth) * clamp(at, -1.0, 1.0))


def base_frequency(rank: Column) -> Column:
    return F.lit(BASE_HZ) * F.pow(F.lit(2.0), rank / F.lit(float(CLASSES)))


def waveform(kind: Column, phase: Column) -> Column:
    """A sample of the waveform of a shape type (0 to 5): sine, triangle, square, sawtooth, pulse, sine."""
    p = phase - F.floor(phase)
    level = lambda share: F.when(p < share, 1.0).otherwise(-1.0)
    return F.when(kind == 1, 2.0 * F.abs(2.0 * p - 1.0) - 1.0).when(kind == 2, level(0.5)).when(kind == 3, 2.0 * p - 1.0).when(kind == 4, level(PULSE_DUTY)).otherwise(F.sin(F.lit(6.283185307179586) * p))


def sample_count(frames: Column, rate: Column | int, fps: Column | int) -> Column:
    """Samples that a number of frames takes, rounded up."""
    return F.floor((frames.cast("bigint") * F.lit(rate) + F.lit(fps) - 1) / F.lit(fps)).cast("bigint")


def clamp_i16(v: Column) -> Column:
    """A 16-bit sample: clamped, then cut towards zero."""
    return clamp(v, -32768.0, 32767.0).cast("int")


def rgb(name: Column) -> Column:
    out = F.array(*map(F.lit, GREY))
    for colour, parts in RGB.items():
        out = F.when(name == colour, F.array(*map(F.lit, parts))).otherwise(out)
    return out


def inverse(colour: Column) -> Column:
    return F.transform(colour, lambda c: 255 - c)


def layout(panels: Column, resolution: Column | int) -> dict[str, Column]:
    """The grid of a picture of several panels: columns, rows, size of a panel, and the gap between panels."""
    columns = F.greatest(F.ceil(F.sqrt(panels.cast("double"))), F.lit(1)).cast("bigint")
    rows = F.ceil(panels / columns).cast("bigint")
    thumb = F.greatest(F.floor(F.lit(resolution) / columns), F.lit(24)).cast("bigint")
    return {"cols": columns, "rows": rows, "thumb": thumb, "gutter": F.greatest(F.floor(thumb / 8), F.lit(2)).cast("bigint")}


def frame_delay(fps: Column) -> Column:
    """Hundredths of a second that an animation's frame stays, rounded; at least one."""
    fps = F.greatest(fps.cast("bigint"), F.lit(1))
    return F.greatest(F.floor((F.floor(fps / 2) + 100) / fps), F.lit(1)).cast("bigint")


def marker_radius(resolution: Column, shape: Column) -> Column:
    """The radius of a shape's marker in pixels."""
    base = F.greatest(F.floor(resolution / 64), F.lit(5)).cast("bigint")
    return F.when(shape == "triangle", F.floor((base * 3 + 1) / 2)).when(shape == "star", base * 2).when(shape == "circle", base + 2).otherwise(base + 1).cast("bigint")


def border_width(resolution: Column) -> Column:
    """The width of a key frame's border in pixels."""
    return F.greatest(F.floor(resolution * 3 / 100), F.lit(1)).cast("bigint")
