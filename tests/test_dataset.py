"""Scenes, their targets, tables, texts, sounds, pictures and files."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import geometry, identity, sentences
from tessella.operators import checks, splits
from tessella.plans import dataset
from tessella.sources import codecs, scenes
from tessella.sources.config import Config, ConfigError, cbor


@pytest.fixture(scope="module")
def config():
    return Config.from_toml()


@pytest.fixture(scope="module")
def some(spark, config):
    return scenes.generate(spark, config, 4).cache()


def test_config_round_trip_and_rules(config):
    assert Config.from_toml(config.to_toml()).data == config.data
    assert len(config.hash()) == 64 and config.hash() == config.replaced(master_seed=7).hash() != config.replaced(parallelism__num_threads=5).hash()
    for bad in ({"master_seed": 65536}, {"scene__n_shapes": 7}, {"scene__n_shapes": 2}, {"site_graph__site_k": 32}, {"scene__motion_events_per_shape": [13, 1, 1]}, {"scene__text_typo_rate": 1.5}, {"positional_landscape__x_steepness": 0.0}, {"scene__easing_family": "bounce"}):
        with pytest.raises(ConfigError):
            config.replaced(**bad)
    assert config.preset("obstruction")["scene.text_reference_frame"] == "mixed"
    assert config.preset("spectral_gap")["site_graph.site_k"] == 3
    assert cbor({"a": [1, -2, 1.5, 0.1, True, "x"]}).hex() == "a16161860121f93e00fb3fb999999999999af56178"


def test_scenes_depend_on_index_only(spark, config, some):
    whole = {r.scene_index: r for r in some.collect()}
    assert scenes.generate(spark, config, 1, 2).collect() == [whole[2]]
    got = [r for b in scenes.batches(spark, config, 3, 4) for r in b.collect()]
    assert {r.scene_index: r for r in got} == whole
    for r in whole.values():
        assert [len([e for e in r.events if e.shape_index == i]) for i in range(3)] == [3, 4, 5]
        assert sorted(e.global_event_index for e in r.events) == list(range(12))
        assert len({(e.shape_index, e.time_slot) for e in r.events}) == 12
    with pytest.raises(ValueError):
        scenes.generate(spark, config, 0)


def test_points_and_targets(some, config):
    p = scenes.points(some, config, 4)
    assert p.where("abs(x) > 1 or abs(y) > 1").isEmpty() and p.count() == 4 * (12 * 4 + 3)
    t = dataset.targets(some, config, 4).collect()
    kinds = {}
    for r in t:
        kinds.setdefault((r.scene_index, r.task_id), []).append(r)
    assert len(kinds) == 4 * 10
    for (_, task), rows in kinds.items():
        assert sorted(r.segment_index for r in rows) == list(range(len(rows)))
        if task.startswith("oqp"):
            assert all(abs(sum(r["values"]) - 1) < 1e-9 for r in rows)
            crossings = kinds[rows[0].scene_index, "xct" + task[3:]][0]["values"][0]
            assert crossings == len(rows) - 1
        if task.startswith("zqh"):
            assert 1 <= rows[0]["values"][0] <= 5 and rows[0]["values"][1] in (0, 1, 2, 3)


def test_csv_and_text(some, config):
    for r in dataset.csv_lines(dataset.tabular(some, config)).collect():
        assert len(r.csv.splitlines()) == 13 and r.csv.endswith("\n")
    told = dataset.text(some, config).orderBy("scene_index", "line_no").collect()
    first = [r.line for r in told if r.scene_index == 0]
    assert first[0] == "Scene " + "0" * 32 + ": 12 motion events."
    assert len(first) == 1 + 12 + 12 * 3
    both = dataset.text(some, config, peers_first=True, vertical_first=True)
    parts = lambda df: sorted(map(str, df.where("line_no between 1 and 999999").select("scene_index", *(c.alias(k) for k, c in sentences.read_event(F.col("line")).items())).collect()))
    assert parts(both) == parts(dataset.text(some, config)) and "None" not in parts(both)[0]
    pairs = lambda df: sorted(map(str, df.where("line_no >= 1000000").select("scene_index", *(c.alias(k) for k, c in sentences.read_pair(F.col("line")).items())).collect()))
    assert pairs(both) == pairs(dataset.text(some, config)) and "None" not in pairs(both)[0]


def test_sound_pictures_frames(some, config):
    one = some.where("scene_index = 1")
    rate, samples = codecs.read_wav(dataset.sound(one, config).first().wav)
    assert rate == 8000 and samples.shape == (12 * 8000, 2) and 0 < np.abs(samples.astype(int)).max() <= 0.7 * 32767
    pixels = codecs.read_png(dataset.pictures(one, config, 64).first().png)
    assert pixels.shape == (64, 64, 3) and len(np.unique(pixels.reshape(-1, 3), axis=0)) > 1
    f = dataset.frames(one, config)
    assert f.count() == 3 * 12 * 24 and f.where("abs(x) > 1 or abs(y) > 1").isEmpty()


def test_materialise_and_tampering(spark, some, config, tmp_path):
    counts = {r.kind: r.files for r in dataset.materialise(some, config, str(tmp_path), 4).collect()}
    assert counts == {"target": 40, "latent": 4, "tabular": 4, "text": 4, "sound": 4, "image": 4}
    stored = spark.read.parquet(f"{tmp_path}/artifacts").withColumn("key", F.concat_ws("/", "kind", "scene_id", "name")).withColumn("sha", F.sha2("content", 256))
    fresh = dataset.artifacts(some, config, 4).withColumn("key", F.concat_ws("/", "kind", "scene_id", "name")).withColumn("sha", F.sha2("content", 256))
    assert checks.parity(fresh, stored, "key", ["sha"]).isEmpty()
    bad = stored.withColumn("sha", F.when(F.col("key").startswith("text/"), F.lit("x")).otherwise(F.col("sha"))).where("kind <> 'latent'")
    assert checks.parity(fresh, bad, "key", ["sha"]).groupBy("fault").count().orderBy("fault").collect() == [("missing", 4), ("sha differs", 4)]


def test_codecs():
    rows = [[0.1, 0.2], [0.3, 0.4]]
    data = codecs.write_target("s", "oqp0000", rows)
    assert codecs.read_target(data) == ("s", "oqp0000", rows)
    assert codecs.read_latent(codecs.write_latent("s", [1.0, -2.5])) == ("s", [1.0, -2.5])
    graph = (3, [(0, 1, 0.5), (1, 2, 1.0)], 0.25, (1, 2, 4 / 3))
    assert codecs.read_graph(codecs.write_graph(*graph)) == graph
    for call in (lambda: codecs.read_target(data + b"x"), lambda: codecs.read_latent(data), lambda: codecs.write_target("s" * 33, "t", rows), lambda: codecs.write_latent("s", [float("nan")]), lambda: codecs.read_graph(codecs.write_graph(1, [(0, 1, 0.5)], 0.1, (0, 1, 1.0)))):
        with pytest.raises(codecs.CodecError):
            call()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**63 - 1))
def test_words_with_one_error(n):
    word = sentences.VOCABULARY[n % 50]
    variants = sorted(sentences.typo_variants(word))
    assert word not in variants and all(abs(len(v) - len(word)) <= 1 for v in variants)


def test_splitmix(spark):
    def plain(v):
        m = 2**64 - 1
        v = (v + 0x9E3779B97F4A7C15) & m
        v = ((v ^ v >> 30) * 0xBF58476D1CE4E5B9) & m
        v = ((v ^ v >> 27) * 0x94D049BB133111EB) & m
        return v ^ v >> 31

    values = [0, 1, -1, 2**63 - 1, -(2**63), *(int(hashlib.md5(bytes([i])).hexdigest()[:15], 16) for i in range(50))]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", identity.splitmix64(F.col("v")).alias("h")).collect()
    assert all(r.h % 2**64 == plain(r.v % 2**64) for r in got)


def test_geometry(spark):
    p = spark.createDataFrame([(x / 4, y / 4) for x in range(-4, 5) for y in range(-4, 5)], "x double, y double")
    for family in ("sigmoid", "tanh"):
        for steep in (0.1, 3.0, 10.0):
            q = geometry.soft_quadrants(geometry.axis_membership(F.col("x"), family, steep), geometry.axis_membership(F.col("y"), family, steep))
            got = p.select("x", "y", q.alias("q"), geometry.on_simplex(q).alias("fine"), geometry.hard_segment(q).alias("hard")).collect()
            assert all(r.fine for r in got)
            assert {(r.x, r.y) for r in got if r.hard} == {(a, b) for a in (-1.0, 1.0) for b in (-1.0, 1.0)}
            assert next(r.q for r in got if r.x == r.y == 0) == pytest.approx([0.25] * 4)
    with pytest.raises(ValueError):
        splits.selected(p, "nothing")


def test_streaming_sessions(spark, small, tmp_path):
    from tessella.streaming import sessions as streaming

    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    windows = streaming.session_windows(stream, "user_id", "ts", "6 hours")
    streaming.run_to_table(windows, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in streaming.session_windows(events, "user_id", "ts", "6 hours").collect()}
    # A stream gives what the watermark has closed; the rest is still open.
    assert got and got <= batch
    assert streaming.deduplicated(stream.unionByName(stream), "event_id", "ts").isStreaming
