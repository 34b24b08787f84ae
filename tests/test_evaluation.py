"""Evaluation plans and sessions; text with noise and its meaning; checks of targets, landscapes and sounds."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import sentences
from tessella.operators import checks
from tessella.plans import dataset, evaluation
from tessella.sources import codecs, scenes
from tessella.sources.config import Config


@pytest.fixture(scope="module")
def config():
    return Config.from_toml()


def test_items_of_sessions(spark):
    rows = evaluation.items(spark.range(40).select((F.col("id") * 10_007).alias("seed")), 3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.seed, []).append(r)
    orders = set()
    for seed, some in by.items():
        some.sort(key=lambda r: r.item)
        assert [r.item for r in some] == list(range(35)) and sum(r.practice for r in some) == 10
        order = [some[i * 7].modality for i in range(5)]
        orders.add(tuple(order))
        assert sorted(order) == sorted(evaluation.MODALITIES)
        for i in range(5):
            assert len({(r.modality, r.question) for r in some[i * 7 : i * 7 + 7]}) == 1
        assert all(r.scene_index == seed // 65536 * 65536 + r.item for r in some)
        assert all(r.task_id == ("lme" if r.question == "lme" else f"{r.question}{r.item % 7 % 3:04d}") for r in some)
    assert len(orders) > 10


def test_plan_with_answers(spark):
    plan = evaluation.plan_of(spark, 70_001, "easy").collect()
    assert len(plan) == 35 and all(r.expected and r.prompt and r.hint for r in plan)
    raw = spark.createDataFrame([(r.answer_kind, r.expected if r.answer_kind != "shape" else sentences_id(r.expected), r.expected) for r in plan], "kind string, expected string, raw string")
    assert raw.where(~sentences.graded(F.col("kind"), F.col("expected"), F.col("raw"))).isEmpty()
    for level in evaluation.LEVELS:
        c = evaluation.level_config(70_001, level)
        assert c["master_seed"] == 70_001 - 65536 and c["scene.n_motion_events_total"] == c["scene.n_motion_slots"] * 3 // 2


def sentences_id(label):
    colour, shape = label.split()
    return f"{shape}_{colour}"


def test_orders_as_text(spark):
    raw = spark.createDataFrame([("2,0, 1,4,3",), ("0,1,2,3",), ("0,1,2,3,3",), ("a,1,2,3,4",), ("0,1,2,3,5",), ("",), (None,)], "raw string")
    got = [r[0] for r in raw.select(evaluation.order_text(evaluation.read_order(F.col("raw")))).collect()]
    assert got == ["2,0,1,4,3", None, None, None, None, None, None]


def test_state_of_sessions(spark):
    log, n = [], 0

    def add(who, kind, item=None, correct=None, ratings=None, human=True):
        nonlocal n
        n += 1
        log.append((who, n, n, kind, human, item, "text" if item is not None else None, correct, ratings))

    add("a", "answer", 0, True)  # refused: not created
    add("a", "create")
    add("a", "create")  # refused
    add("a", "answer", 1, True)  # refused: not its item
    for i in range(4):
        add("a", "answer", i, i == 3)
    add("a", "skip", 4)
    add("a", "ratings", ratings=[1, 2, 3, 4, 5])  # refused: not at the end
    for i in range(7, 35, 7):
        add("a", "skip", i)
    add("a", "ratings", ratings=[1, 2, 2, 4, 5])  # refused
    add("a", "ratings", ratings=[5, 4, 3, 2, 1])
    add("a", "ratings", ratings=[1, 2, 3, 4, 5])  # refused: completed
    add("b", "create", human=False)
    add("b", "skip", 0)  # refused: no person
    rows = spark.createDataFrame(log, "session_id string, ts long, event_id long, kind string, is_human boolean, item int, modality string, correct boolean, ratings array<int>")
    got = {r.session_id: r for r in evaluation.state(rows).collect()}
    a, b = got["a"], got["b"]
    assert (a.cursor, a.completed, a.ratings, a.refused, a.right["text"], a.wrong["text"]) == (35, True, [5, 4, 3, 2, 1], 6, 1, 1)
    assert a.skipped == [4, 5, 6, *range(7, 35)]
    assert (b.cursor, b.completed, b.refused, b.created) == (0, False, 1, True)


def test_requests_for_data(spark):
    asked = spark.createDataFrame([("a", 1, "easy", "text", 3), ("a", 1, "easy", "text", 4), ("c", 1, "easy", "text", 3)], "session_id string, seed int, difficulty string, modality string, scene_index int")
    now = spark.createDataFrame([("a", 1, "easy", "text", 3)], asked.schema)
    assert [r.allowed for r in evaluation.allowed(asked, now).orderBy("session_id", "scene_index").collect()] == [True, False, False]
    shapes = spark.createDataFrame([(None, "s1", "s0", ["s0", "s1"]), ("x", "s1", "s0", ["s0"]), (None, None, "s0", ["s0"])], "a string, b string, c string, d array<string>")
    assert [r[0] for r in shapes.select(evaluation.resolved_shape(*map(F.col, "abcd"))).collect()] == ["s1", None, "s0"]


def test_noisy_text_keeps_its_meaning(spark, config):
    made = scenes.generate(spark, config, 3).cache()
    clean = sentences.decoded(spark, dataset.text(made, config))
    assert sentences.text_faults(clean).isEmpty() and clean.where("kind = 'unread'").isEmpty()
    noisy = dataset.text(made, config.replaced(scene__text_synonym_rate=0.5))
    assert noisy.exceptAll(dataset.text(made, config)).count() > 10
    other = dataset.text(made, config.replaced(scene__text_synonym_rate=1.0), peers_first=True, vertical_first=True)
    for t in (noisy, other):
        assert sentences.decoded(spark, t).exceptAll(clean).isEmpty()
    # Typing errors that no word or several explain are left; all lines that can be read tell what was meant.
    wrong = sentences.decoded(spark, dataset.text(made, config.replaced(scene__text_typo_rate=0.05)))
    assert wrong.where("kind <> 'unread'").exceptAll(clean).isEmpty()
    lines = dataset.text(made, config)
    for bad, fault in ((lines.where("line_no <> 2"), "event index"), (lines.where("line_no <> 0"), "header"), (lines.where("line_no <> 12"), "event count"), (lines.where("line_no <> 1000001"), "pair index"), (lines.union(lines.limit(1).select("scene_index", "line_no", F.lit("hello"))), "unread")):
        assert fault in {r.fault for r in sentences.text_faults(sentences.decoded(spark, bad)).collect()}


def test_synonym_candidates(spark):
    raw = spark.createDataFrame([(" Moved ",), ("re-do",), ("",), (None,), ("été",)], "w string")
    assert [r[0] for r in raw.select(sentences.synonym_candidate(F.col("w"))).collect()] == ["moved", None, None, None, None]


def test_target_faults(spark, config):
    made = scenes.generate(spark, config, 2)
    t = dataset.targets(made, config, 4).cache()
    asked = made.select("scene_index").crossJoin(dataset.expected_tasks(spark, 3))
    assert checks.target_faults(t, asked, ["scene_index"]).isEmpty()
    assert checks.target_report(t.where("scene_index = 0")).first().target_count == 10
    nan = F.array(F.lit(float("nan")))
    bad = t.where("not (scene_index = 0 and task_id = 'lme')").withColumn("values", F.when((F.col("scene_index") == 1) & (F.col("task_id") == "xct0000"), nan).when((F.col("scene_index") == 1) & (F.col("task_id") == "oqp0001"), F.transform("values", lambda v: v * 2)).otherwise(F.col("values")))
    bad = bad.where("not (scene_index = 1 and task_id = 'oqp0002' and segment_index = 0)").union(t.limit(1).select("scene_index", F.lit("abc0000"), "segment_index", "values"))
    got = {tuple(r) for r in checks.target_faults(bad, asked, ["scene_index"]).collect()}
    assert {(0, "lme", "missing"), (1, "xct0000", "not finite"), (1, "oqp0001", "sum"), (1, "oqp0002", "segments")} <= got and any(f == "unexpected" for *_, f in got)


def test_samples_of_sound(spark, config):
    made = scenes.generate(spark, config, 3).cache()
    e = scenes.motion_events(made, config)
    want = {r.scene_index: r.expected for r in checks.expected_samples(e, 12, 8000, 24, ["scene_index"]).collect()}
    got = {r.scene_index: codecs.read_wav(r.wav)[1].shape for r in dataset.sound(made, config).collect()}
    assert got == {i: (n, 2) for i, n in want.items()}
    odd = spark.createDataFrame([(1, 0, 2, 10), (1, 1, 2, 11), (2, 0, 0, 3), (3, 0, 9, 5), (4, 0, 1, 7)], "s int, list_pos int, time_slot int, duration_frames int")
    got = {r.s: (r.expected, r.fault) for r in checks.expected_samples(odd, 3, 100, 10, ["s"]).collect()}
    assert got[1][1] == "durations" and got[2] == (90, None) and got[3][1] == "slot" and got[4] == (210, None)


def test_landscape(spark):
    q = lambda a, b: checks.landscape_verdict(spark.createDataFrame([(a,)], "a double"), spark.createDataFrame([(b,)], "b double")).first().fault
    assert (q(2.0, 0.05), q(1.9, 0.0), q(2.5, 0.01)) == (None, "quadrants", "corners")
