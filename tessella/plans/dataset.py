"""The plans of a dataset: what is derived from scenes, and how it is written and checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import identity, media, sentences
from ..operators import checks, runs, splits
from ..sources import codecs, scenes
from ..sources.config import Config


def memberships(points: DataFrame, config: Config, soft: bool = True) -> DataFrame:
    """points with the soft quadrants q and the dominant one; both null where only trajectories are wanted."""
    if not soft:
        return points.withColumn("q", F.lit(None).cast("array<double>")).withColumn("dom", F.lit(None).cast("int"))
    p = config["positional_landscape"]
    u, v = g.axis_membership(F.col("x"), p["x_nonlinearity"], p["x_steepness"]), g.axis_membership(F.col("y"), p["y_nonlinearity"], p["y_steepness"])
    return points.withColumn("q", g.soft_quadrants(u, v)).withColumn("dom", g.dominant(F.col("q")))


def targets(of: DataFrame, config: Config, per_event: int) -> DataFrame:
    """(scene_index, task_id, segment_index, values): quadrant passages, crossing counts, quadrants after moves, and the shape of the largest motion.

    A shape without events has no row of the third kind.
    """
    keys = ["scene_index", "shape_index"]
    soft = memberships(scenes.points(of, config, per_event), config)
    task = lambda kind: F.format_string(f"{kind}%04d", "shape_index")
    passages = runs.run_means(soft, keys, ["step"], "dom", "q").select("scene_index", task("oqp").alias("task_id"), F.col("run").alias("segment_index"), F.array("m0", "m1", "m2", "m3").alias("values"))
    crossings = runs.transitions(soft, keys, ["step"], "dom").select("scene_index", task("xct").alias("task_id"), F.lit(0).alias("segment_index"), F.array(F.col("transitions").cast("double")).alias("values"))
    events = scenes.motion_events(of, config)
    asked = identity.query_index(F.col("scene_index") + F.lit(config["master_seed"]), F.col("shape_index"), F.col("_n"))
    moves = runs.nth(events, keys, ["shape_event_index", "global_event_index"], asked)
    quadrant = g.hard_quadrant(F.col("end_x"), F.col("end_y"))
    after = moves.select("scene_index", task("zqh").alias("task_id"), F.lit(0).alias("segment_index"), F.array(F.col("move").cast("double"), quadrant.cast("double")).alias("values"))
    ranks = identity.classes(of.sparkSession).select("shape_id", "class_rank")
    named = of.select("scene_index", F.explode("identities").alias("s")).select("scene_index", F.concat_ws("_", "s.shape_type", "s.color").alias("shape_id")).join(F.broadcast(ranks), "shape_id")
    least = named.groupBy("scene_index").agg(F.min("class_rank").alias("least"))
    d2 = g.squared_distance(F.col("start_x"), F.col("start_y"), F.col("end_x"), F.col("end_y"))
    moved = events.join(F.broadcast(ranks), "shape_id").groupBy("scene_index").agg(F.array_sort(F.collect_list(F.struct("list_pos", d2.alias("d2"), "class_rank"))).alias("moves"))
    rank = farthest(F.coalesce("moves", F.array().cast("array<struct<list_pos:int,d2:double,class_rank:int>>")), F.col("least"))
    most = least.join(moved, "scene_index", "left").select("scene_index", F.lit("lme").alias("task_id"), F.lit(0).alias("segment_index"), F.array(rank.cast("double")).alias("values"))
    return passages.unionByName(crossings).unionByName(after).unionByName(most)


#: How many sampled paths a landscape is checked on, segments of the paths for either figure, and points of a segment.
LANDSCAPE_PATHS, QUADRANT_SEGMENTS, CORNER_SEGMENTS, SEGMENT_POINTS = 1000, 3, 5, 24


def sampled_paths(indices: DataFrame, config: Config, segments: int) -> DataFrame:
    """(sample, seg, k, x, y): straight paths between random points, a pure function of seed and sample; both ends of a path count, each inner corner once."""
    master = config["master_seed"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(int(i), s, *a, *b) for i in f["sample"] for s, a, b in scenes.random_way(master, int(i), segments)], columns=["sample", "seg", "x0", "y0", "x1", "y1"])

    ways = indices.select("sample").mapInPandas(run, "sample bigint, seg int, x0 double, y0 double, x1 double, y1 double")
    at = F.when(F.col("seg") == 0, F.sequence(F.lit(0), F.lit(SEGMENT_POINTS))).otherwise(F.sequence(F.lit(1), F.lit(SEGMENT_POINTS)))
    w = ways.withColumn("k", F.explode(at))
    t = F.col("k") / F.lit(float(SEGMENT_POINTS))
    return w.select("sample", "seg", "k", g.lerp(F.col("x0"), F.col("x1"), t).alias("x"), g.lerp(F.col("y0"), F.col("y1"), t).alias("y"))


def landscape(spark: SparkSession, config: Config, paths: int = LANDSCAPE_PATHS) -> DataFrame:
    """One row: how many quadrants dominate on a path on average, the share of paths that come near a corner, and what they fail."""
    indices = spark.range(paths).withColumnRenamed("id", "sample")
    seen = memberships(sampled_paths(indices, config, QUADRANT_SEGMENTS), config).groupBy("sample").agg(F.countDistinct("dom").alias("n")).agg(F.avg("n"))
    near = memberships(sampled_paths(indices, config, CORNER_SEGMENTS), config).groupBy("sample").agg(F.bool_or(g.near_corner(F.col("q"))).alias("near")).agg(F.avg(F.col("near").cast("double")))
    return checks.landscape_verdict(seen, near)


def sound_report(of: DataFrame, config: Config) -> DataFrame:
    """(scene_index, channels, rate, samples, expected, fault): what each scene's sound holds when it is read back, beside what it should."""
    scene = config["scene"]
    channels = 1 if scene["sound_channel_mapping"] == "mono_mix" else 2

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [codecs.read_wav(bytes(w)) for w in f["wav"]]
            yield pd.DataFrame({"scene_index": f["scene_index"], "channels": [s.shape[1] for _, s in got], "rate": [r for r, _ in got], "samples": [len(s) for _, s in got]})

    told = sound(of, config).mapInPandas(read, "scene_index bigint, channels int, rate int, samples bigint")
    asked = checks.expected_samples(scenes.motion_events(of, config), scene["n_motion_slots"], scene["sound_sample_rate_hz"], scene["sound_frames_per_second"], ["scene_index"])
    wrong = F.coalesce("fault", F.when(F.col("channels") != channels, "channels").when(F.col("rate") != scene["sound_sample_rate_hz"], "rate").when(F.col("samples") < 1, "empty").when(F.col("samples") != F.col("expected"), "samples"))
    return told.join(asked, "scene_index", "full").withColumn("fault", F.when(F.col("samples").isNull(), "missing").otherwise(wrong)).select("scene_index", "channels", "rate", "samples", "expected", "fault")


#: Fixed value: squared distances that differ by less are equal.
TIE = 1e-12


def farthest(moves: Column, fallback: Column) -> Column:
    """The rank of the shape of the largest motion among moves (d2, class_rank, in list order); of equal motions the least rank, and fallback where nothing moves."""

    def step(best: Column, m: Column) -> Column:
        more = m["d2"] > best["d2"] + TIE
        equal = (F.abs(m["d2"] - best["d2"]) <= TIE) & (m["class_rank"] < best["rank"])
        return F.struct(F.when(more, m["d2"]).otherwise(best["d2"]).alias("d2"), F.when(more | equal, m["class_rank"]).otherwise(best["rank"]).alias("rank"))

    return F.aggregate(moves, F.struct(F.lit(-1.0).alias("d2"), fallback.cast("int").alias("rank")), step, lambda s: s["rank"])


def expected_tasks(spark: SparkSession, shapes: int) -> DataFrame:
    """(task_id, place): the targets that a scene of so many shapes has, shape by shape, then that of the scene."""
    kinds = F.array(*(F.format_string(f"{kind}%04d", "id") for kind in ("oqp", "xct", "zqh")))
    of_shapes = spark.range(shapes).select(F.posexplode(kinds).alias("at", "task_id"), (F.col("id") * 3).alias("first")).select("task_id", (F.col("first") + F.col("at")).alias("place"))
    return of_shapes.union(spark.range(1).select(F.lit("lme"), F.lit(3 * shapes).cast("bigint")))


def target_lines(t: DataFrame, digits: int = 6) -> DataFrame:
    """(scene_index, text): targets as text, task by task: its number of segments, then each segment's values."""
    values = F.array_join(F.transform("values", lambda v: F.format_string(f"%.{digits}f", v)), ",")
    line = F.concat(F.lit("segment="), F.col("segment_index").cast("string"), F.lit(",values="), values)
    tasks = t.groupBy("scene_index", "task_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", line.alias("line")))).alias("rows"))
    head = F.concat(F.lit("task_id="), "task_id", F.lit(",segment_count="), F.size("rows").cast("string"))
    body = F.array_join(F.concat(F.array(head), F.transform("rows", lambda r: r["line"])), "\n")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task_id", body.alias("body")))), lambda r: r["body"]), "\n")
    return tasks.groupBy("scene_index").agg(whole.alias("text"))


def tabular(of: DataFrame, config: Config) -> DataFrame:
    """One row for each event, with the other events of its slot."""
    e = scenes.motion_events(of, config)
    rows = runs.peers(e, ["scene_index", "time_slot"], "global_event_index", "simultaneous_event_ids")
    return rows.select("scene_index", "list_pos", "scene_id", F.col("global_event_index").alias("event_index"), "shape_type", "color", "start_x", "start_y", "end_x", "end_y", "simultaneous_event_ids")


def csv_lines(rows: DataFrame) -> DataFrame:
    """(scene_index, csv): each scene's table as text, rows in list order, numbers rounded away from zero to three places."""
    three = [F.format_string("%.3f", sentences.round_away(F.col(c))) for c in ("start_x", "start_y", "end_x", "end_y")]
    line = F.concat_ws(",", "scene_id", F.col("event_index").cast("string"), "shape_type", "color", *three, F.array_join("simultaneous_event_ids", "|"))
    head = "scene_id,event_index,shape_type,color,start_x,start_y,end_x,end_y,simultaneous_event_ids"
    body = F.transform(F.array_sort(F.collect_list(F.struct("list_pos", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("scene_index").agg(F.concat(F.lit(head + "\n"), F.array_join(body, "\n"), F.lit("\n")).alias("csv"))


def latents(of: DataFrame, config: Config) -> DataFrame:
    """(scene_index, scene_id, vector): start and end of each event, in list order."""
    from ..operators.graph import flattened

    return flattened(scenes.motion_events(of, config), ["scene_index", "scene_id"], "list_pos", ["start_x", "start_y", "end_x", "end_y"])


def text(of: DataFrame, config: Config, peers_first: bool = False, vertical_first: bool = False) -> DataFrame:
    """(scene_index, line_no, line): the header, a sentence for each event in order, and one for each pair of shapes after each event."""
    scene = config["scene"]
    e = runs.peers(scenes.motion_events(of, config), ["scene_index", "time_slot"], "global_event_index", "peers")
    n = max(scene["event_duration_frames"], 2)
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: g.easing(i / F.lit(float(n - 1)), scene["easing_family"]))
    quads = F.transform(at, lambda t: g.text_quadrant(g.lerp(F.col("start_x"), F.col("end_x"), t), g.lerp(F.col("start_y"), F.col("end_y"), t)))
    path = F.filter(quads, lambda q, i: (i == 0) | (q != F.get(quads, i - 1)))
    frame = scene["text_reference_frame"]
    relative = F.pmod(F.xxhash64("scene_index", "global_event_index", F.lit(2)), F.lit(2)) == 0 if frame == "mixed" else F.lit(frame == "relative")

    def vary(line: Column, tag: int) -> Column:
        seed = F.xxhash64("scene_index", "line_no", F.lit(tag))
        return sentences.mistype(sentences.vary(line, scene["text_synonym_rate"], seed), scene["text_typo_rate"], seed)

    lines = e.select("scene_index", (F.col("global_event_index") + 1).alias("line_no"), sentences.event_sentence(F.col("global_event_index"), F.col("shape_id"), path, F.col("peers"), peers_first, relative).alias("line"))
    lines = lines.withColumn("line", vary(F.col("line"), 1))
    head = of.select("scene_index", F.lit(0).cast("bigint").alias("line_no"), sentences.header(F.col("scene_id"), F.size("events")).alias("line"))
    # Where each shape is after each event, in the order of event numbers.
    names = of.select("scene_index", F.explode("identities").alias("s")).select("scene_index", F.col("s.shape_index").alias("shape"), F.concat_ws("_", "s.shape_type", "s.color").alias("name"))
    point = lambda which: F.struct(F.col(f"{which}_x").alias("x"), F.col(f"{which}_y").alias("y"))
    first = F.when(F.col("shape_event_index") == 0, point("start"))
    moved = e.select("scene_index", F.col("global_event_index").alias("event"), F.col("shape_index").alias("mover"), point("end").alias("end"), first.alias("first"))
    grid = moved.join(names, "scene_index").withColumn("_end", F.when(F.col("mover") == F.col("shape"), F.col("end")))
    anchor = F.max(F.when(F.col("mover") == F.col("shape"), F.col("first"))).over(Window.partitionBy("scene_index", "shape"))
    placed = runs.last_known(grid.withColumn("_anchor", anchor), ["scene_index", "shape"], ["event"], "_end", F.col("_anchor"), "at").where("at is not null")
    a = placed.select("scene_index", "event", F.col("shape").alias("i"), F.col("name").alias("a"), F.col("at").alias("p"))
    b = placed.select("scene_index", "event", F.col("shape").alias("j"), F.col("name").alias("b"), F.col("at").alias("r"))
    pairs = a.join(b, ["scene_index", "event"]).where("i < j")
    pairs = pairs.withColumn("pair", (F.row_number().over(Window.partitionBy("scene_index").orderBy("event", "i", "j")) - 1).cast("bigint"))
    relations = sentences.horizontal_relation(F.col("p.x"), F.col("r.x")), sentences.vertical_relation(F.col("p.y"), F.col("r.y"))
    told = pairs.select("scene_index", (F.col("pair") + 1_000_000).alias("line_no"), sentences.pair_sentence(F.col("pair"), F.col("event"), F.col("a"), F.col("b"), *relations, vertical_first).alias("line"))
    return head.unionByName(lines).unionByName(told.withColumn("line", vary(F.col("line"), 2)))


def text_files(lines: DataFrame) -> DataFrame:
    """(scene_index, text): the lines of each scene in order, each with a line end."""
    return lines.groupBy("scene_index").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def frames(of: DataFrame, config: Config) -> DataFrame:
    """(scene_index, time_slot, frame, shape_index, x, y): where each shape is in each frame; it stays where it was between its events."""
    scene = config["scene"]
    e = scenes.motion_events(of, config).withColumn("s", F.struct(F.col("start_x").alias("x"), F.col("start_y").alias("y"))).withColumn("z", F.struct(F.col("end_x").alias("x"), F.col("end_y").alias("y")))
    slots = of.sparkSession.range(scene["n_motion_slots"]).withColumnRenamed("id", "time_slot")
    shapes = of.where(F.size("events") > 0).select("scene_index", F.explode(F.sequence(F.lit(0), F.lit(scene["n_shapes"] - 1))).alias("shape_index"))
    moves = e.select("scene_index", "shape_index", "time_slot", "s", "z", "shape_event_index")
    grid = runs.slot_grid(shapes, slots, moves, ["scene_index", "shape_index", "time_slot"])
    whole = Window.partitionBy("scene_index", "shape_index")
    first = F.min(F.when(F.col("s").isNotNull(), F.struct("time_slot", "s"))).over(whole)["s"]
    held = runs.carried(grid.withColumn("_first", first), ["scene_index", "shape_index"], ["time_slot"], "s", "z", F.col("_first"), "from").where("`from` is not null")
    n = scene["event_duration_frames"]
    t = g.easing(g.progress(F.col("frame"), F.lit(n)), scene["easing_family"])
    to = F.coalesce("z", "from")
    held = held.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return held.select("scene_index", "time_slot", "frame", "shape_index", g.lerp(F.col("from.x"), to["x"], t).alias("x"), g.lerp(F.col("from.y"), to["y"], t).alias("y"))


def sound(of: DataFrame, config: Config) -> DataFrame:
    """(scene_index, wav): each event is heard in its slot with the waveform of its type, pitched by rank and x, as loud as y says; scaled down if it peaks."""
    scene = config["scene"]
    rate, fps, depth, stereo = scene["sound_sample_rate_hz"], scene["sound_frames_per_second"], scene["sound_modulation_depth_per_mille"] / 1000, scene["sound_channel_mapping"] != "mono_mix"
    per_slot = (scene["event_duration_frames"] * rate + fps - 1) // fps
    ranks = identity.classes(of.sparkSession).select("shape_id", "class_rank", F.col("shape_index").alias("kind"))
    e = scenes.motion_events(of, config).join(F.broadcast(ranks), "shape_id")
    e = e.withColumn("peers", F.count("*").over(Window.partitionBy("scene_index", "time_slot")))
    s = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_slot - 1))))
    p = g.easing(g.progress(F.col("i"), F.lit(per_slot)), scene["easing_family"])
    x, y = g.lerp(F.col("start_x"), F.col("end_x"), p), g.lerp(F.col("start_y"), F.col("end_y"), p)
    phase = media.modulated(media.base_frequency(F.col("class_rank").cast("double")), x, depth) * F.col("i") / float(rate)
    loud = media.modulated(F.lit(0.35 * media.I16_MAX) / F.col("peers"), y, depth)
    left, right = media.pan(x)
    level = media.waveform(F.col("kind"), phase) * loud
    mixed = s.groupBy("scene_index", (F.col("time_slot") * per_slot + F.col("i")).alias("at")).agg(F.sum(level * (left if stereo else 1.0)).alias("l"), F.sum(level * (right if stereo else 1.0)).alias("r"))
    frames_in_all = scene["n_motion_slots"] * per_slot

    def write(key, f: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((frames_in_all, 2 if stereo else 1))
        out[f["at"].to_numpy(), 0] = f["l"]
        if stereo:
            out[f["at"].to_numpy(), 1] = f["r"]
        peak = np.abs(out).max(initial=0.0)
        if peak > media.PEAK_SHARE * media.I16_MAX:
            out *= media.PEAK_SHARE * media.I16_MAX / peak
        return pd.DataFrame({"scene_index": [key[0]], "wav": [codecs.write_wav(np.trunc(np.clip(out, -32768, 32767)), rate)]})

    return mixed.groupBy("scene_index").applyInPandas(write, "scene_index bigint, wav binary")


def pictures(of: DataFrame, config: Config, resolution: int | None = None) -> DataFrame:
    """(scene_index, png): one canvas for all events of a scene."""
    from .pictures import canvases

    return canvases(of, config, resolution)


def artifacts(of: DataFrame, config: Config, per_event: int, with_frames: bool = False) -> DataFrame:
    """(kind, scene_id, name, content): the binary and text files of all scenes, as rows; the frames of films only if asked for."""
    from .pictures import comics, films

    def target(key, f: pd.DataFrame) -> pd.DataFrame:
        rows = [list(v) for v in f.sort_values("segment_index")["values"]]
        return pd.DataFrame({"kind": ["target"], "scene_id": [key[0]], "name": [key[1]], "content": [codecs.write_target(key[0], key[1], rows)]})

    def latent(frames_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames_:
            yield pd.DataFrame({"kind": "latent", "scene_id": f["scene_id"], "name": "latent", "content": [codecs.write_latent(i, list(v)) for i, v in zip(f["scene_id"], f["vector"])]})

    schema = "kind string, scene_id string, name string, content binary"
    t = targets(of, config, per_event).withColumn("scene_id", identity.scene_id(F.col("scene_index")))
    out = t.groupBy("scene_id", "task_id").applyInPandas(target, schema).union(latents(of, config).mapInPandas(latent, schema))
    named = lambda df, kind, content: df.select(F.lit(kind).alias("kind"), identity.scene_id(F.col("scene_index")).alias("scene_id"), F.lit(kind).alias("name"), F.col(content).cast("binary").alias("content"))
    lines = text_files(text(of, config))
    out = out.union(named(csv_lines(tabular(of, config)), "tabular", "csv")).union(named(lines, "text", "text"))
    out = out.union(named(sound(of, config), "sound", "wav")).union(named(comics(of, config), "image", "png"))
    return out.union(_frames(films(of, config))) if with_frames else out


def _frames(films: DataFrame) -> DataFrame:
    return films.select(F.lit("video").alias("kind"), identity.scene_id(F.col("scene_index")).alias("scene_id"), F.format_string("frame_%06d", "frame").alias("name"), F.col("png").alias("content"))


def materialise(of: DataFrame, config: Config, path: str, per_event: int) -> DataFrame:
    """Write all artifacts as Parquet by kind, and the splits; returns how many files of each kind there are."""
    artifacts(of, config, per_event).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/artifacts")
    splits.split_by_position(of.select("scene_id"), "scene_id").write.mode("overwrite").parquet(f"{path}/splits")
    return of.sparkSession.read.parquet(f"{path}/artifacts").groupBy("kind").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("bytes"))
