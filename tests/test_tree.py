"""A dataset's files: written, checked after tampering, exported, previewed; and its pictures, pixel by pixel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import __main__ as cli
from tessella.functions import raster
from tessella.plans import dataset, pictures, tree
from tessella.sources import codecs, scenes
from tessella.sources.config import Config

COUNT, PER_EVENT = 3, 4


@pytest.fixture(scope="module")
def config():
    small = {"scene__resolution": 48, "scene__n_motion_slots": 4, "scene__motion_events_per_shape": [2, 1, 2], "scene__event_duration_frames": 2, "scene__sound_sample_rate_hz": 240, "site_graph__validation_scene_count": 12, "site_graph__site_k": 5, "site_graph__lambda2_iterations": 3}
    return Config.from_toml().replaced(**small)


@pytest.fixture(scope="module")
def made(spark, config, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree") / "data")
    return root, tree.generate(spark, config, root, COUNT, PER_EVENT)


def test_tree_is_whole(spark, config, made):
    root, record = made
    assert record["target_file_count"] == COUNT * 10 and record["video_frame_file_count"] == COUNT * 8
    assert {record[k] for k in ("latent_artifact_count", "sound_file_count", "tabular_file_count", "text_file_count", "image_file_count")} == {COUNT}
    t = dataset.targets(scenes.generate(spark, config, COUNT), config, PER_EVENT)
    assert record["total_target_segments"] == t.count()
    assert tree.faults(spark, config, root, COUNT, PER_EVENT).collect() == []
    assert tree.record(root, "split_assignments.toml")["summary"]["total_count"] == COUNT
    assert sorted(r.task_id for r in dataset.expected_tasks(spark, 3).collect()) == sorted({r.task_id for r in t.where("scene_index = 0").collect()})


def test_each_tampering_is_found(spark, config, made, tmp_path):
    import shutil

    root = str(tmp_path / "bad")
    shutil.copytree(made[0], root)
    first = f"{0:032x}"
    with open(f"{root}/tabular/{first}.csv", "a") as f:
        f.write("x")
    import os

    os.remove(f"{root}/sound/{first}.wav")
    shutil.copy(f"{root}/image/{first}.png", f"{root}/image/extra.png")
    os.remove(f"{root}/video_frames/{first}/frame_000003.png")
    for name, old, new in (("materialization.toml", "image_file_count = 3", "image_file_count = 4"), ("site_metadata.toml", "site_k = 5", "site_k = 6"), ("split_assignments.toml", 'split = "test"', 'split = "train"'), ("config.toml", "n_shapes = 3", "n_shapes = 2")):
        with open(f"{root}/metadata/{name}") as f:
            text = f.read()
        assert old in text
        with open(f"{root}/metadata/{name}", "w") as f:
            f.write(text.replace(old, new))
    with open(f"{root}/metadata/site_graph.sfg", "ab") as f:
        f.write(b"x")
    found = {tuple(r) for r in tree.faults(spark, config, root, COUNT, PER_EVENT).collect()}
    assert {(f"tabular/{first}.csv", "content"), (f"sound/{first}.wav", "missing"), ("image/extra.png", "unexpected"), (f"video_frames/{first}/frame_000003.png", "missing")} <= found
    assert {("metadata/materialization.toml", "image_file_count"), ("metadata/site_metadata.toml", "site_k"), ("metadata/config.toml", "config_hash"), ("metadata/site_graph.sfg", "wrong length")} <= found
    assert sum(p == "metadata/split_assignments.toml" and f.endswith("split differs") for p, f in found) == 1
    assert len(found) == 9


def test_export_of_a_split(spark, config, made, tmp_path):
    root, out = made[0], str(tmp_path / "out")
    manifest = tree.exported(spark, root, out, "TRAIN")
    n = tree.record(root, "split_assignments.toml")["summary"]["train_count"]
    assert manifest["selected_scene_count"] == manifest["latent_file_count"] == manifest["video_scene_dir_count"] == n and manifest["target_file_count"] == 10 * n
    got = {r.path: r.content for r in tree.listed(spark, out).where("not startswith(path, 'metadata')").collect()}
    want = {r.path: r.content for r in tree.listed(spark, root).collect()}
    assert len(got) == n * (10 + 5 + 8) and all(want[p] == c for p, c in got.items())
    with pytest.raises(ValueError):
        tree.exported(spark, root, out, "nothing")


def test_a_scene_may_stand_under_two_names(spark):
    canonical, kinds = f"{5:032x}", ["targets/{}_lme.sft", "latent/{}.bin", "tabular/{}.csv", "text/{}.txt", "image/{}.png", "sound/{}.wav", "video_frames/{}/frame_000000.png"]
    paths = [(k.format(canonical),) for k in kinds] + [(k.format("scene_7"),) for k in kinds] + [(k.format("scene_8"),) for k in kinds[1:]]
    chosen = spark.createDataFrame([("scene_5",), ("scene_7",), ("scene_8",), (canonical,)], "scene_id string")
    got = {r.scene_id: r.source_id for r in tree.sources(chosen, spark.createDataFrame(paths, "path string")).collect()}
    assert got == {"scene_5": canonical, "scene_7": "scene_7", "scene_8": None, canonical: canonical}


def test_commands(spark, config, made, tmp_path, capsys, monkeypatch):
    path = str(tmp_path / "config.toml")
    with open(path, "w") as f:
        f.write(config.to_toml())
    run = lambda *a: (cli.main([a[0], "--config", path, *a[1:]]), capsys.readouterr().out)
    assert config.hash() in run("hash-config")[1]
    code, out = run("targets", "--scene-index", "1", "--samples-per-event", "4", "--task-id", "xct")
    assert code == 0 and out.count("segment_count=1") == 3
    code, out = run("inspect-scene", "--samples-per-event", "4")
    assert code == 0 and "motion_event_count=5" in out and out.count("shape_index=") == 3
    code, out = run("preview", "--output", str(tmp_path / "p"), "--samples-per-event", "4")
    assert code == 0 and "video_frame_count=8" in out
    names = {r.path for r in tree.listed(spark, str(tmp_path / "p")).collect()}
    assert {f"{0:032x}/{x}" for x in ("targets.txt", "image.png", "sound.wav", "text.txt", "tabular.csv", "video_frames/frame_000007.png")} <= names and len(names) == 13
    assert run("validate", "--output", made[0], "--scene-count", str(COUNT), "--samples-per-event", str(PER_EVENT)) == (0, "validation=ok\n")
    assert run("site-stats")[0] == 0


def test_shapes_on_a_canvas():
    image = raster.canvas(21, 21)
    raster.filled(image, "circle", (10, 10), 3, (1, 2, 3))
    on = (image == (1, 2, 3)).all(axis=2)
    yy, xx = np.mgrid[:21, :21]
    assert (on == ((xx - 10) ** 2 + (yy - 10) ** 2 <= 9)).all()
    for shape in ("triangle", "square", "pentagon", "hexagon", "star"):
        image = raster.canvas(41, 41)
        raster.filled(image, shape, (20, 20), 12, (9, 9, 9))
        on = (image == (9, 9, 9)).all(axis=2)
        assert on[20, 20] and not on[0, 0] and 60 < on.sum() < 460, shape
        raster.outlined(image, shape, (20, 20), 12)
        assert (image == 0).all(axis=2).sum() > 30
    image = raster.canvas(10, 10)
    raster.line(image, (-3, 2), (20, 2), raster.BLACK)
    assert (image[2] == 0).all() and (image[3] == 255).all()
    raster.arrow(image, (4, 4), (4, 4))
    assert raster.short_of((0, 0), (10, 0), 4.0) == (6, 0) and raster.short_of((0, 0), (3, 0), 4.0) == (3, 0)
    assert [raster.half_up(v) for v in (0.5, -0.5, 2.4, -2.6)] == [1, -1, 2, -3]
    assert raster.pixel(-1, 1, 48) == (0, 0) and raster.pixel(1, -1, 48) == (47, 47)


def test_comic_and_film(spark, config):
    of = scenes.generate(spark, config, 2)
    for arrows in ("prev", "current", "next"):
        c = config.replaced(scene__image_arrow_type=arrows, scene__image_frame_scatter=arrows == "prev")
        image = codecs.read_png(pictures.comics(of, c).orderBy("scene_index").first().png)
        assert image.shape == (2 * 24 + 3 * 3, 2 * 24 + 3 * 3, 3)
        assert (image == raster.RED).all(axis=2).any() and (image == 0).all(axis=2).any()
    placed = of.select(pictures.panels(F.col("scene_index") + 42, 9, 300).alias("p")).collect()
    for r in placed:
        assert len({(x.x, x.y) for x in r.p}) == 9 and all(0 <= x.corner < 4 for x in r.p)
        assert [(x.x, x.y) for x in r.p] != sorted(((x.x, x.y) for x in r.p), key=lambda q: (q[1], q[0]))
    film = pictures.films(of.where("scene_index = 0"), config.replaced(scene__video_keyframe_border=True)).orderBy("frame").collect()
    assert [r.frame for r in film] == list(range(8))
    frames = [codecs.read_png(r.png) for r in film]
    assert all(tuple(f[0, 0]) == (raster.BORDER if i % 2 else raster.GUIDE) for i, f in enumerate(frames))
