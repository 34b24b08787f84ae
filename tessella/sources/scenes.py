"""Scenes: generated from (configuration, index) alone, as nested rows, and as tables.

Each scene has four independent random streams of its own seeds. The draws come from a counter-based generator of numpy; they have
the stated distributions, but are other numbers than any other program's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import identity
from .config import Config

SCHEMA = (
    "scene_index bigint, scene_id string, identities array<struct<shape_index:int,shape_type:string,color:string>>, "
    "waypoints array<struct<shape_index:int,segment:int,x0:double,y0:double,x1:double,y1:double>>, "
    "events array<struct<list_pos:int,global_event_index:bigint,time_slot:bigint,shape_index:int,shape_event_index:int,duration_frames:int>>"
)


def _stream(seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=seed))


def _counts(scene: dict, rng: np.random.Generator) -> list[int]:
    """How many events each shape has: given, or drawn, and brought down to the budget by taking events off random shapes above their least."""
    n, slots = scene["n_shapes"], scene["n_motion_slots"]
    given, ranges = scene["motion_events_per_shape"], scene["motion_events_per_shape_random_ranges"]
    least = [0] * n
    if ranges:
        least = [r["min"] for r in ranges]
        counts = [int(rng.integers(r["min"], r["max"] + 1)) for r in ranges]
    elif scene["randomize_motion_events_per_shape"] and not given:
        counts = [int(rng.integers(0, slots + 1)) for _ in range(n)]
    else:
        counts = list(given)
    room = slots * (n if scene["allow_simultaneous"] else 1)
    budget = min(room, scene["n_motion_events_total"] if scene["n_motion_events_total"] is not None else room)
    while sum(counts) > budget:
        open_ = [i for i in range(n) if counts[i] > least[i]]
        if not open_:
            raise ValueError("the least counts exceed the budget")
        counts[open_[int(rng.integers(len(open_)))]] -= 1
    return counts


def _events(scene: dict, counts: list[int], rng: np.random.Generator) -> list[dict]:
    """Events in shape order, with their slots and a random numbering in which simultaneous events are not all neighbours, if that can be had in 32 tries."""
    slots = scene["n_motion_slots"]
    if scene["allow_simultaneous"]:
        taken = [sorted(rng.permutation(slots)[:c].tolist()) if c else [] for c in counts]
    else:
        pool = iter(sorted(rng.permutation(slots)[: sum(counts)].tolist()))
        taken = [[next(pool) for _ in range(c)] for c in counts]
    rows = [{"time_slot": s, "shape_index": i, "shape_event_index": j} for i, own in enumerate(taken) for j, s in enumerate(own)]
    for _ in range(33):
        order = rng.permutation(len(rows)).tolist()
        by_slot: dict[int, list[int]] = {}
        for r, k in zip(rows, order):
            by_slot.setdefault(r["time_slot"], []).append(k)
        shared = [v for v in by_slot.values() if len(v) > 1]
        if not shared or any(abs(a - b) != 1 for v in shared for a in v for b in v if a != b):
            break
    return [{"list_pos": p, "global_event_index": k, **r, "duration_frames": scene["event_duration_frames"]} for p, (r, k) in enumerate(zip(rows, order))]


def generate(spark: SparkSession, config: Config, count: int, index: int = 0) -> DataFrame:
    """Scenes index to index + count - 1, one row each (SCHEMA). Filters on the index belong into the arguments."""
    if count < 1 or index < 0:
        raise ValueError("count must be positive and index not negative")
    return from_indices(spark.range(index, index + count).withColumnRenamed("id", "scene_index"), config)


def random_way(master: int, i: int, segments: int) -> list[tuple[int, list[float], list[float]]]:
    """The segments (number, start, end) of a random path, from the trajectory stream of an index."""
    points = _stream(master + i + identity.SEED_OFFSETS["trajectory"]).uniform(-1, 1, (segments + 1, 2)).tolist()
    return [(s, a, b) for s, (a, b) in enumerate(zip(points, points[1:]))]


def one(config: Config, i: int) -> dict:
    """The scene of an index, as a nested row (SCHEMA)."""
    scene, master = config["scene"], config["master_seed"]
    layout, path = _stream(master + i), _stream(master + i + identity.SEED_OFFSETS["trajectory"])
    counts = _counts(scene, layout)
    ways = []
    for s, c in enumerate(counts):
        points = path.uniform(-1, 1, (c + 1, 2)).tolist()
        ways += [{"shape_index": s, "segment": k, "x0": a[0], "y0": a[1], "x1": b[0], "y1": b[1]} for k, (a, b) in enumerate(zip(points, points[1:]))]
    events = _events(scene, counts, layout)
    names = _stream(master + i + 10_000_019)
    if scene["shape_identity_assignment"] == "index_locked":
        colours = names.permutation(6).tolist()
        pairs = [(s, colours[s % 6]) for s in range(scene["n_shapes"])]
    else:
        pairs = [divmod(int(p), 6) for p in names.permutation(36)[: scene["n_shapes"]]]
    ids = [{"shape_index": s, "shape_type": identity.SHAPES[a], "color": identity.COLOURS[b]} for s, (a, b) in enumerate(pairs)]
    return {"scene_index": i, "scene_id": f"{i:032x}", "identities": ids, "waypoints": ways, "events": events}


def from_indices(indices: DataFrame, config: Config) -> DataFrame:
    """Scenes of the indices in scene_index, from a batch or a stream."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([one(config, int(i)) for i in f["scene_index"]], columns=["scene_index", "scene_id", "identities", "waypoints", "events"])

    return indices.select("scene_index").mapInPandas(run, SCHEMA)


def points(scenes: DataFrame, config: Config, per_event: int) -> DataFrame:
    """(scene_index, shape_index, step, x, y): shapes' paths, one point at the start and per_event for each event, bent sideways by the configured complexity."""
    if per_event < 1:
        raise ValueError("per_event must be positive")
    bend = 0.12 * (config["scene.trajectory_complexity"] - 1)
    w = scenes.select("scene_index", F.explode("waypoints").alias("w")).select("scene_index", "w.*")
    steps = F.when(F.col("segment") == 0, F.sequence(F.lit(0), F.lit(per_event))).otherwise(F.sequence(F.lit(1), F.lit(per_event)))
    w = w.withColumn("k", F.explode(steps)).withColumn("t", F.col("k") / F.lit(float(per_event)))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = F.sqrt(dx * dx + dy * dy)
    inner = (F.col("k") > 0) & (F.col("k") < per_event) & (length > 0)
    side = F.when(inner, F.when(F.col("segment") % 2 == 0, 1.0).otherwise(-1.0) * bend * F.sin(F.lit(3.141592653589793) * F.col("t"))).otherwise(0.0)
    unit = F.when(length > 0, length).otherwise(1.0)
    x = g.clamp(g.lerp(F.col("x0"), F.col("x1"), F.col("t")) - dy / unit * side, -1.0, 1.0)
    y = g.clamp(g.lerp(F.col("y0"), F.col("y1"), F.col("t")) + dx / unit * side, -1.0, 1.0)
    return w.select("scene_index", "shape_index", (F.col("segment") * per_event + F.col("k")).alias("step"), x.alias("x"), y.alias("y"))


def motion_events(scenes: DataFrame, config: Config) -> DataFrame:
    """One row for each event, with its start and end and its shape's identity."""
    e = scenes.select("scene_index", "scene_id", F.explode("events").alias("e"), "waypoints", "identities")
    way = F.filter("waypoints", lambda w: (w["shape_index"] == F.col("e.shape_index")) & (w["segment"] == F.col("e.shape_event_index")))[0]
    who = F.filter("identities", lambda s: s["shape_index"] == F.col("e.shape_index"))[0]
    out = e.select("scene_index", "scene_id", "e.*", way.alias("w"), who.alias("s"))
    ends = [F.col(f"w.{a}").alias(b) for a, b in (("x0", "start_x"), ("y0", "start_y"), ("x1", "end_x"), ("y1", "end_y"))]
    shape = [F.col("s.shape_type").alias("shape_type"), F.col("s.color").alias("color"), F.concat_ws("_", "s.shape_type", "s.color").alias("shape_id")]
    event = ["scene_index", "scene_id", "list_pos", "global_event_index", "time_slot", "shape_index", "shape_event_index", "duration_frames"]
    return out.select(*event, F.lit(config["scene.easing_family"]).alias("easing"), *ends, *shape)


def batches(spark: SparkSession, config: Config, batch_size: int, num_samples: int | None = None, index: int = 0, loop: bool = False) -> Iterator[DataFrame]:
    """Scenes in batches, the last one cut to num_samples; with loop there is no end, and indices go on growing."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    if not loop and num_samples is None:
        raise ValueError("num_samples is needed unless loop is set")
    at = index
    while loop or at < index + num_samples:
        size = batch_size if loop else min(batch_size, index + num_samples - at)
        yield generate(spark, config, size, at)
        at += size
