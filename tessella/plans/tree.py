"""A dataset as a tree of files: written, listed, checked against what its configuration says, exported by split, previewed.

Files are rows (path, content) until the last step: executors write and read them, through the store that the path names, and the driver
handles the few records of the metadata folder only. The list of splits, which has a row for each scene, is streamed.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import checks, graph, splits
from ..operators.cutting import cut
from ..sources import codecs, scenes
from ..sources.config import SCHEMA_VERSION, Config
from . import dataset, pictures

#: The folder and the ending of each kind of artifact.
KINDS = {"latent": "bin", "tabular": "csv", "text": "txt", "image": "png", "sound": "wav"}
SCHEMA = "path string, content binary"


def files(of: DataFrame, config: Config, per_event: int) -> DataFrame:
    """(path, content) of all artifacts of scenes, paths relative to the tree."""
    a = dataset.artifacts(of, config, per_event, with_frames=True)
    path = F.when(F.col("kind") == "target", F.concat(F.lit("targets/"), "scene_id", F.lit("_"), "name", F.lit(".sft")))
    path = path.when(F.col("kind") == "video", F.concat(F.lit("video_frames/"), "scene_id", F.lit("/"), "name", F.lit(".png")))
    for kind, ending in KINDS.items():
        path = path.when(F.col("kind") == kind, F.concat(F.lit(f"{kind}/"), "scene_id", F.lit(f".{ending}")))
    return a.select(path.alias("path"), "content")


def _opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def write(rows: DataFrame, root: str) -> int:
    """Write rows (path, content) as files under root, from the executors; root must be a store that all of them see. Returns how many there are.

    A task that runs again writes the same files again.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("path", "content").mapInArrow(work, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length) of all files under root, paths relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    tail = F.substring(F.col("path"), F.instr("path", base) + len(base), F.length("path"))
    return found.select(tail.alias("path"), "content", "length")


def toml(record: dict[str, Any]) -> str:
    """A record as TOML: values, then tables, then lists of tables."""

    def shown(v: Any) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return repr(v)

    lines = [f"{k} = {shown(v)}" for k, v in record.items() if not isinstance(v, (dict, list))]
    for k, v in record.items():
        for table, head in [(v, f"[{k}]")] if isinstance(v, dict) else [(x, f"[[{k}]]") for x in v] if isinstance(v, list) else []:
            lines += ["", head, *(f"{a} = {shown(b)}" for a, b in table.items())]
    return "\n".join(lines) + "\n"


def record(root: str, name: str) -> dict[str, Any]:
    """A record of the metadata folder."""
    store, base = _opened(root)
    with store.open_input_stream(f"{base}/metadata/{name}") as f:
        return tomllib.loads(f.read().decode())


def _put(root: str, path: str, parts) -> None:
    store, base = _opened(root)
    store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{base}/{path}") as f:
        for part in parts:
            f.write(part)


def identity_record(config: Config) -> dict[str, Any]:
    return {"master_seed": config["master_seed"], "config_hash": config.hash(), "schema_version": SCHEMA_VERSION}


def site(spark: SparkSession, config: Config) -> tuple[dict[str, Any], DataFrame, str | None]:
    """The graph of the configuration's first scenes: its record, its edges, and what it fails (null: nothing).

    Guards come in order: sizes, one component, no hub of more than five times site_k, a spectral estimate that is finite and high enough.
    """
    s = config["site_graph"]
    count, k = s["validation_scene_count"], s["site_k"]
    made = scenes.generate(spark, config, count)
    rows = dataset.latents(made, config).select(F.col("scene_index").alias("id"), "vector")
    lengths = rows.agg(F.countDistinct(F.size("vector")).alias("n"), F.count("*").alias("rows")).first()
    flat = cut(graph.padded(rows, "vector"))
    least = min(k, count - 1)
    edges = cut(graph.undirected(graph.knn(flat, "id", "vector", least)))
    stats = graph.degree_stats(graph.degrees(flat, edges, "id")).first()
    parts = graph.components(flat, edges, "id").select("component").distinct().count()
    lambda2 = graph.lambda2(flat, edges, "id", s["lambda2_iterations"], config["master_seed"]).first()[0]
    out = {
        **identity_record(config), "scene_count": count, "site_k": k, "effective_k": least, "undirected_edge_count": edges.count(), "connected_components": parts,
        "min_degree": stats["min_degree"], "max_degree": stats["max_degree"], "mean_degree": stats["mean_degree"], "lambda2_estimate": lambda2,
    }
    ragged = lengths["n"] != 1 and config["scene.motion_events_per_shape_random_ranges"] is None and not config["scene.randomize_motion_events_per_shape"]
    low = lambda2 is None or lambda2 != lambda2 or lambda2 < s["lambda2_min"]
    fault = "size" if least < 1 else "lengths" if ragged else "components" if parts != 1 else "hub" if stats["max_degree"] > 5 * k else "lambda2" if low else None
    return out, edges, fault


def site_file(report: dict[str, Any], edges: DataFrame) -> bytes:
    """The binary form of a site graph; it has at most validation_scene_count x site_k edges, whatever the dataset's size."""
    rows = [(r.src, r.dst, r.weight) for r in edges.orderBy("src", "dst").select("src", "dst", "weight").toLocalIterator()]
    return codecs.write_graph(report["scene_count"], rows, report["lambda2_estimate"], (report["min_degree"], report["max_degree"], report["mean_degree"]))


def assignments(of: DataFrame) -> DataFrame:
    """(scene_id, split) of scenes, by place."""
    return splits.split_by_position(of.select("scene_id"), "scene_id")


def _splits_toml(config: Config, parts: DataFrame) -> Iterator[bytes]:
    """Head and summary, then each scene: streamed, as there is one for each scene."""
    n = splits.counts(parts).first()
    yield toml({**identity_record(config), "summary": {"train_count": n["train"], "val_count": n["val"], "test_count": n["test"], "total_count": n["total"]}}).encode()
    for r in parts.orderBy("scene_id").toLocalIterator():
        yield toml({"assignments": [{"scene_id": r["scene_id"], "split": r["split"]}]}).encode()


def counters(paths: DataFrame) -> dict[str, int]:
    """How many files of each kind there are (path), and segments of targets (content, if it is there)."""
    folder = F.substring_index("path", "/", 1)
    names = {"targets": "target_file_count", "latent": "latent_artifact_count", "sound": "sound_file_count", "tabular": "tabular_file_count", "text": "text_file_count", "image": "image_file_count", "video_frames": "video_frame_file_count"}
    # A target file's number of segments stands after magic, version and identifiers: 4 bytes, the least first.
    width = codecs.SCENE_WIDTH + codecs.TASK_WIDTH
    number = F.conv(F.hex(F.reverse(F.substring(F.col("content"), 9 + width, 4))), 16, 10).cast("bigint") if "content" in paths.columns else F.lit(0)
    out = paths.agg(*(F.count_if(folder == k).alias(v) for k, v in names.items()), F.sum(F.when(folder == "targets", number)).alias("total_target_segments")).first().asDict()
    return {k: v or 0 for k, v in out.items()}


def generate(spark: SparkSession, config: Config, root: str, count: int, per_event: int) -> dict[str, Any]:
    """Write the whole tree of a dataset; returns its materialisation record. A site graph that fails a guard is an error, before anything is written."""
    if per_event < 1:
        raise ValueError("per_event must be positive")
    made = scenes.generate(spark, config, count)
    report, edges, fault = site(spark, config)
    if fault:
        raise ValueError(f"the site graph fails: {fault}")
    _put(root, "metadata/config.toml", [config.to_toml().encode()])
    _put(root, "metadata/site_graph.sfg", [site_file(report, edges)])
    _put(root, "metadata/site_metadata.toml", [toml(report).encode()])
    _put(root, "metadata/split_assignments.toml", _splits_toml(config, assignments(made)))
    write(files(made, config, per_event), root)
    out = {**identity_record(config), "scene_count": count, "samples_per_event": per_event, **counters(listed(spark, root))}
    _put(root, "metadata/materialization.toml", [toml(out).encode()])
    return out


def faults(spark: SparkSession, config: Config, root: str, count: int, per_event: int) -> DataFrame:
    """(path, fault): what is wrong with a tree: files that are missing, unasked for or of another content than the configuration gives, and fields of its records that don't hold."""
    observed = listed(spark, root)
    made = scenes.generate(spark, config, count)
    sha = F.sha2(F.col("content"), 256).alias("sha")
    art = observed.where(~F.col("path").startswith("metadata/"))
    wrong = checks.parity(files(made, config, per_event).select("path", sha), art.select("path", sha), "path", ["sha"])
    wrong = wrong.select("path", F.when(F.col("fault") == "sha differs", "content").otherwise(F.col("fault")).alias("fault"))
    rows: list[tuple[str, str]] = []
    report, edges, site_fault = site(spark, config)
    want = {
        "site_metadata.toml": report,
        "materialization.toml": {**identity_record(config), "scene_count": count, "samples_per_event": per_event, **counters(files(made, config, per_event))},
        "split_assignments.toml": identity_record(config),
        "config.toml": {"master_seed": config["master_seed"]},
    }
    if site_fault:
        rows.append(("metadata/site_graph.sfg", site_fault))
    for name, fields in want.items():
        try:
            got = record(root, name)
        except FileNotFoundError:
            rows.append((f"metadata/{name}", "missing"))
            continue
        except tomllib.TOMLDecodeError:
            rows.append((f"metadata/{name}", "unreadable"))
            continue
        for field, value in fields.items():
            same = abs(got.get(field, float("nan")) - value) <= 1e-12 if isinstance(value, float) and isinstance(got.get(field), (int, float)) else got.get(field) == value
            if not same:
                rows.append((f"metadata/{name}", field))
        if name == "config.toml" and Config(got, check=False).hash() != config.hash():
            rows.append((f"metadata/{name}", "config_hash"))
        if name == "split_assignments.toml":
            stored = spark.createDataFrame([(a["scene_id"], a["split"]) for a in got.get("assignments", [])], "scene_id string, split string")
            off = checks.parity(assignments(made), stored, "scene_id", ["split"])
            wrong = wrong.union(off.select(F.lit(f"metadata/{name}"), F.concat_ws(" ", "scene_id", "fault")))
    graph_file = observed.where("path = 'metadata/site_graph.sfg'").select("content").first()
    try:
        if graph_file is None or codecs.read_graph(bytes(graph_file[0])) != codecs.read_graph(site_file(report, edges)):
            rows.append(("metadata/site_graph.sfg", "content" if graph_file else "missing"))
    except codecs.CodecError as e:
        rows.append(("metadata/site_graph.sfg", str(e)))
    return wrong.union(spark.createDataFrame(rows, "path string, fault string"))


def _scene_of(path: Column) -> tuple[Column, Column, Column]:
    """The folder of an artifact's path, the id of the scene that it is of, and what follows the id."""
    folder = F.substring_index(path, "/", 1)
    name = F.substring(path, F.length(folder) + 2, F.length(path))
    of = F.when(folder == "targets", F.regexp_extract(name, "^(.*)_[^_]*$", 1)).when(folder == "video_frames", F.substring_index(name, "/", 1)).otherwise(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1))
    return folder, of, F.substring(name, F.length(of) + 1, F.length(name))


def sources(chosen: DataFrame, paths: DataFrame) -> DataFrame:
    """(scene_id, source_id): under which id the files of each chosen scene (scene_id) stand in paths (path): the first in order, of its own id and, for an id `scene_N`, that of scene N, that has a file of every kind; null if none has."""
    folder, of, _ = _scene_of(F.col("path"))
    whole = paths.where(folder.isin("targets", "video_frames", *KINDS)).select(of.alias("source_id"), folder.alias("folder")).distinct().groupBy("source_id").agg(F.count("*").alias("kinds")).where(F.col("kinds") == 2 + len(KINDS))
    number = F.regexp_extract("scene_id", "^scene_([0-9]+)$", 1)
    other = F.when(number != "", identity.scene_id(number.try_cast("bigint")))
    asked = chosen.select("scene_id", F.explode(F.array_distinct(F.array_compact(F.array("scene_id", other)))).alias("source_id"))
    found = asked.join(whole.select("source_id"), "source_id").groupBy("scene_id").agg(F.min("source_id").alias("source_id"))
    return chosen.select("scene_id").distinct().join(found, "scene_id", "left")


def exported(spark: SparkSession, root: str, out: str, choice: str) -> dict[str, Any]:
    """Copy the scenes of a split to a tree of their own, under their assigned ids; returns its manifest. A chosen scene without all kinds of files is an error.

    Configuration and site records are copied as they are; identifiers inside files stay.
    """
    stored = record(root, "split_assignments.toml")
    rows = spark.createDataFrame([(a["scene_id"], a["split"]) for a in stored.get("assignments", [])], "scene_id string, split string")
    chosen = splits.selected(rows, choice)
    there = listed(spark, root)
    of = cut(sources(chosen, there.select("path")))
    lost = of.where("source_id is null").first()
    if lost:
        raise LookupError(f"scene {lost['scene_id']} lacks files")
    for name in ("config.toml", "site_graph.sfg", "site_metadata.toml"):
        _put(out, f"metadata/{name}", [bytes(there.where(F.col("path") == f"metadata/{name}").select("content").first()[0])])
    n = splits.counts(chosen).first()
    head = {k: stored[k] for k in ("master_seed", "config_hash", "schema_version")}
    summary = {"train_count": n["train"], "val_count": n["val"], "test_count": n["test"], "total_count": n["total"]}
    _put(out, "metadata/split_assignments.toml", [toml({**head, "summary": summary, "assignments": [{"scene_id": r["scene_id"], "split": r["split"]} for r in chosen.orderBy("scene_id").toLocalIterator()]}).encode()])
    folder, key, rest = _scene_of(F.col("path"))
    moved = there.where(~F.col("path").startswith("metadata/")).select("content", folder.alias("folder"), key.alias("source_id"), rest.alias("rest")).join(of, "source_id")
    copied = moved.select(F.concat_ws("/", "folder", F.concat("scene_id", "rest")).alias("path"), "content")
    write(copied, out)
    made = counters(listed(spark, out).select("path"))
    manifest = {
        "split": choice.lower(), "selected_scene_count": chosen.count(), "target_file_count": made["target_file_count"], **{f"{k}_file_count": made[f"{k}_artifact_count" if k == "latent" else f"{k}_file_count"] for k in KINDS},
        "video_scene_dir_count": chosen.count(),
    }
    _put(out, "metadata/export_split.toml", [toml(manifest).encode()])
    return manifest


def preview(spark: SparkSession, config: Config, root: str, index: int, per_event: int) -> dict[str, Any]:
    """Write one scene's artifacts to a folder of its own, with its targets as text; returns what there is."""
    made = scenes.generate(spark, config, 1, index)
    found = files(made, config, per_event)
    kind, tail = F.substring_index("path", "/", 1), F.substring_index("path", "/", -1)
    path = F.when(kind == "video_frames", F.concat(F.lit("video_frames/"), tail)).otherwise(F.concat(kind, F.lit("."), F.substring_index("path", ".", -1)))
    named = made.select(identity.scene_id(F.col("scene_index")).alias("id")).first()["id"]
    t = dataset.targets(made, config, per_event)
    told = dataset.target_lines(t).select(F.lit("targets.txt").alias("path"), F.col("text").cast("binary").alias("content"))
    kept = found.where(kind.isin("video_frames", "tabular", "text", "image", "sound")).select(path.alias("path"), "content").union(told)
    write(kept, f"{root}/{named}")
    report = checks.target_report(t).first().asDict()
    return {"scene_id": named, "scene_index": index, "samples_per_event": per_event, **report, "video_frame_count": found.where(kind == "video_frames").count()}


def inspected(spark: SparkSession, config: Config, index: int, per_event: int) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    """A scene's figures, and those of each of its shapes."""
    made = scenes.generate(spark, config, 1, index)
    e = scenes.motion_events(made, config)
    of_slot = e.groupBy("time_slot").agg(F.countDistinct("shape_index").alias("shapes"))
    slot = of_slot.agg(F.count("*").alias("time_slot_count"), F.count_if(F.col("shapes") > 1).alias("simultaneous_slot_count"), F.coalesce(F.max("shapes"), F.lit(0)).alias("max_shapes_per_slot")).first().asDict()
    points = scenes.points(made, config, per_event).groupBy("shape_index").agg(F.count("*").alias("trajectory_points"))
    moved = e.groupBy("shape_index").agg(F.count("*").alias("motion_events"))
    who = made.select(F.explode("identities").alias("s")).select("s.shape_index", F.concat_ws("_", "s.shape_type", "s.color").alias("shape_id"))
    shapes = who.join(points, "shape_index", "left").join(moved, "shape_index", "left").na.fill(0).orderBy("shape_index")
    seeds = spark.range(1).select(*(c.alias(n) for n, c in identity.seeds(F.lit(config["master_seed"]), F.lit(index)).items())).first().asDict()
    t = dataset.targets(made, config, per_event)
    return {"scene_id": f"{index:032x}", "scene_index": index, "motion_event_count": e.count(), **slot, **seeds, **checks.target_report(t).first().asDict()}, [r.asDict() for r in shapes.collect()]
