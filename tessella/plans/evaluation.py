"""Evaluations of people and models: the plan of a session's items, its answers, and the session as a fold over its log.

A session has 35 items: five modalities in an order of its own, each with two items for practice and five that count. A seed decides the order, and
which question each modality asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, identity, sentences
from ..operators import sessions
from ..sources import scenes
from ..sources.config import SEED_SPACE, Config
from . import dataset

#: Modalities and questions in their canonical order, items of a modality, those for practice, and path points of an event.
MODALITIES = ("image", "video", "text", "tabular", "sound")
QUESTIONS = ("oqp", "xct", "zqh", "lme")
ITEMS, PRACTICE, PER_EVENT = 7, 2, 24
#: Salts of the seeds of questions and of the order.
QUESTION_SALT, ORDER_SALT = 0xA71F_C0DE_5EED_0145, 0x4D4F_4441_4C49_5459
#: Slots, shapes, reference frame, synonym rate and typo rate of each level.
LEVELS = {"easy": (4, 3, "canonical", 0.0, 0.0), "medium": (8, 4, "mixed", 0.20, 0.03), "hard": (12, 5, "mixed", 0.45, 0.08)}
#: Whether peers and vertical relations come first in a level's texts.
PROFILES = {"easy": (False, False), "medium": (True, False), "hard": (True, True)}
#: What kind of answer a question wants, and the hint for it.
ANSWERS = {
    "oqp": ("sequence", "Format: comma-separated quadrants (e.g. 1,3,4)"),
    "xct": ("integer", "Enter an integer (e.g. 3)"),
    "zqh": ("quadrant", "Enter one quadrant number: 1, 2, 3, or 4"),
    "lme": ("shape", "Enter shape and color (e.g. red circle)"),
}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _draw(seed: Column, salt: int, at: Column | int, n: int) -> Column:
    """A number below n by a hash of seed, salt and place."""
    place = F.lit(at) if isinstance(at, int) else at
    return identity.unsigned_mod(identity.splitmix64(seed.cast("bigint").bitwiseXOR(F.lit(_signed(salt)).cast("bigint")).bitwiseXOR(F.shiftleft(place.cast("bigint"), 8))), F.lit(n))


def modality_order(seed: Column) -> Column:
    """A permutation of the modalities' numbers (array): by a hash of seed and number, equals by number."""
    keyed = F.transform(F.sequence(F.lit(0), F.lit(len(MODALITIES) - 1)), lambda i: F.struct(_draw(seed, ORDER_SALT, i + 1, 1 << 40).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def order_text(order: Column) -> Column:
    return F.array_join(F.transform(order, lambda i: i.cast("string")), ",")


def read_order(raw: Column) -> Column:
    """The order that a text like "2,0,1,4,3" tells; null unless it is a permutation of all modalities. Blanks are passed over."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda t: F.trim(t)), lambda t: t != "")
    numbers = F.transform(parts, lambda t: F.when(t.rlike(r"^\+?[0-9]{1,9}$"), t.try_cast("int")))
    return F.when(F.array_sort(numbers) == F.array(*map(F.lit, range(len(MODALITIES)))), numbers)


def questions(seed: Column) -> Column:
    """The question of each modality, in canonical order (array of names)."""
    return F.transform(F.sequence(F.lit(0), F.lit(len(MODALITIES) - 1)), lambda i: F.get(F.array(*map(F.lit, QUESTIONS)), _draw(seed, QUESTION_SALT, i + 1, len(QUESTIONS)).cast("int")))


def items(of_sessions: DataFrame, shapes: int, seed: str = "seed") -> DataFrame:
    """of_sessions (with a seed each) times its items: item, modality, question, practice, scene_index (beyond the seed space moved on), query_shape (null where all shapes are asked about), task_id."""
    plan = of_sessions.withColumn("_order", modality_order(F.col(seed))).withColumn("_questions", questions(F.col(seed)))
    plan = plan.withColumn("item", F.explode(F.sequence(F.lit(0), F.lit(len(MODALITIES) * ITEMS - 1))))
    canonical = F.get("_order", F.floor(F.col("item") / ITEMS).cast("int"))
    plan = plan.withColumn("modality", F.get(F.array(*map(F.lit, MODALITIES)), canonical)).withColumn("question", F.get("_questions", canonical))
    shape = (F.col("item") % ITEMS) % shapes
    asked = F.col("question") != "lme"
    return plan.select(
        *of_sessions.columns, F.col("item").cast("bigint").alias("item"), "modality", "question", (F.col("item") % ITEMS < PRACTICE).alias("practice"), identity.effective_index(F.col(seed), F.col("item")).alias("scene_index"),
        F.when(asked, shape.cast("bigint")).alias("query_shape"), F.when(asked, F.concat("question", F.lpad(shape.cast("string"), 4, "0"))).otherwise(F.lit("lme")).alias("task_id"),
    )


def level_config(seed: int, level: str) -> Config:
    """The configuration of a session: random counts of events from a quarter of the slots to all of them, at most three for two slots in all."""
    slots, shapes, frame, synonyms, typos = LEVELS[level]
    base = Config.from_toml()
    scene = {**base["scene"], "n_shapes": shapes, "n_motion_slots": slots, "allow_simultaneous": True, "randomize_motion_events_per_shape": True, "motion_events_per_shape": [], "n_motion_events_total": slots * 3 // 2}
    scene |= {"motion_events_per_shape_random_ranges": [{"min": slots // 4, "max": slots}] * shapes, "text_reference_frame": frame, "text_synonym_rate": synonyms, "text_typo_rate": typos}
    return Config({**base.data, "master_seed": seed % SEED_SPACE, "scene": scene})


def answers(plan: DataFrame, targets: DataFrame, identities: DataFrame) -> DataFrame:
    """plan with prompt, kind of answer, hint, and the expected answer as text.

    plan has scene_index, question, query_shape and task_id; targets (scene_index, task_id, segment_index, values) those of its scenes; identities
    (scene_index, shape_index, shape_id, class_rank) their shapes. An item whose target is missing or malformed has a null answer.
    """
    v = lambda i: F.get("values", i)
    finite = lambda i: v(i).isNotNull() & ~F.isnan(v(i)) & (F.abs(v(i)) < F.lit(float("inf")))
    first = targets.where("segment_index = 0")
    in_order = F.array_sort(F.collect_list(F.struct("segment_index", (geometry.dominant(F.col("values")) + 1).alias("q"))))
    told = F.array_join(F.transform(in_order, lambda x: x["q"].cast("string")), ",")
    of_shapes = targets.where(F.col("task_id").startswith("oqp")).groupBy("scene_index", "task_id")
    passages = of_shapes.agg(told.alias("told"), F.bool_and(F.size("values") == 4).alias("fine")).select("scene_index", "task_id", F.when(F.col("fine"), F.col("told")).alias("told"), F.lit(None).cast("bigint").alias("moves"))
    crossings = first.where(F.col("task_id").startswith("xct")).select("scene_index", "task_id", F.when(finite(0), F.round(v(0)).cast("bigint").cast("string")).alias("told"), F.lit(None).cast("bigint").alias("moves"))
    sound = (F.size("values") == 2) & finite(0) & finite(1) & (F.round(v(0)) >= 1) & F.round(v(1)).between(0, 3)
    after = first.where(F.col("task_id").startswith("zqh")).select("scene_index", "task_id", F.when(sound, (F.round(v(1)).cast("bigint") + 1).cast("string")).alias("told"), F.when(sound, F.round(v(0)).cast("bigint")).alias("moves"))
    # The first shape of a scene that has the rank.
    ranks = identities.groupBy("scene_index", "class_rank").agg(F.min_by("shape_id", "shape_index").alias("winner"))
    most = first.where("task_id = 'lme'").select("scene_index", "task_id", F.round(v(0)).cast("int").alias("class_rank")).join(ranks, ["scene_index", "class_rank"])
    most = most.select("scene_index", "task_id", sentences.natural_label(F.col("winner")).alias("told"), F.lit(None).cast("bigint").alias("moves"))
    known = passages.unionByName(crossings).unionByName(after).unionByName(most)
    labels = identities.withColumn("label", sentences.natural_label(F.col("shape_id")))
    options = labels.groupBy("scene_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shape_index", "label"))), lambda x: x["label"]), ", ").alias("options"))
    asked = labels.select("scene_index", F.col("shape_index").cast("bigint").alias("query_shape"), "label", F.col("shape_id").alias("query_shape_id"))
    out = plan.join(known, ["scene_index", "task_id"], "left").join(options, "scene_index", "left").join(asked, ["scene_index", "query_shape"], "left")
    shape = F.concat(F.lit("For the "), F.col("label"))
    q = F.col("question")
    prompt = F.when(q == "oqp", F.concat(shape, F.lit(", list the ordered quadrant passage."))).when(q == "xct", F.concat(shape, F.lit(", how many total quadrant crossings occurred?")))
    prompt = prompt.when(q == "zqh", F.concat(shape, F.lit(", what quadrant is it in after it moved "), F.col("moves").cast("string"), F.lit(" times?")))
    which = F.lit("Which shape has traveled the longest distance in a single move between two points?")
    prompt = prompt.when(q == "lme", F.concat(which, F.when(F.coalesce("options", F.lit("")) != "", F.concat(F.lit(" Available options: "), "options", F.lit("."))).otherwise(F.lit(""))))
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, row in ANSWERS.items() for x in (k, row[i]))), q)
    return out.select(*plan.columns, "query_shape_id", prompt.alias("prompt"), pick(0).alias("answer_kind"), pick(1).alias("hint"), F.col("told").alias("expected"))


def plan_of(spark, seed: int, level: str) -> DataFrame:
    """The whole plan of one session: its items with prompts and expected answers, made from its own scenes."""
    config = level_config(seed, level)
    plan = items(spark.createDataFrame([(seed,)], "seed bigint"), config["scene.n_shapes"])
    made = scenes.from_indices(plan.select("scene_index").distinct(), config)
    ranks = identity.classes(spark).select("shape_id", "class_rank")
    who = made.select("scene_index", F.explode("identities").alias("s")).select("scene_index", "s.shape_index", F.concat_ws("_", "s.shape_type", "s.color").alias("shape_id")).join(F.broadcast(ranks), "shape_id")
    return answers(plan, dataset.targets(made, config, PER_EVENT), who)


#: The kinds of events in a session's log, in the order in which they are applied when their times are equal.
EVENTS = ("create", "answer", "skip", "ratings")


def state(log: DataFrame, key: str = "session_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The session rows that a log leaves: key, created, cursor, right and wrong of each modality (practice is not counted), skipped items, ratings, completed, refused.

    log has key, order, kind (EVENTS), is_human, item (the one that is answered or from which on is skipped), modality, correct, ratings (five numbers).
    An event counts only while its session exists and isn't completed; an answer or a skip only at the session's own item, a skip only of a person's session;
    ratings only once all items are done, and only a permutation of 1 to 5. All else is refused. A session's log is folded in one aggregate: it has
    at most a few events for each of its 35 items.
    """
    total = len(MODALITIES) * ITEMS
    e = F.array_sort(F.collect_list(F.struct(*order, "kind", "is_human", F.col("item").cast("int").alias("item"), "modality", "correct", "ratings")))
    none = F.lit(0).cast("bigint")
    count = F.map_from_arrays(F.array(*map(F.lit, MODALITIES)), F.array(*[none] * len(MODALITIES)))
    start = F.struct(
        F.lit(False).alias("created"), F.lit(False).alias("human"), F.lit(0).alias("cursor"), count.alias("right"), count.alias("wrong"), F.array().cast("array<int>").alias("skipped"),
        F.lit(None).cast("array<int>").alias("ratings"), F.lit(False).alias("completed"), none.alias("refused"),
    )

    def step(s: Column, x: Column) -> Column:
        kind, open_ = x["kind"], s["created"] & ~s["completed"]
        create = (kind == "create") & ~s["created"]
        here = open_ & (s["cursor"] < total) & (x["item"] == s["cursor"])
        answer, skip = (kind == "answer") & here, (kind == "skip") & here & s["human"]
        rated = F.array_sort(x["ratings"]) == F.array(*map(F.lit, range(1, len(MODALITIES) + 1)))
        ratings = (kind == "ratings") & open_ & (s["cursor"] >= total) & F.coalesce(rated, F.lit(False))
        counts = answer & (s["cursor"] % ITEMS >= PRACTICE)
        plus = lambda m, on: F.transform_values(m, lambda k, n: n + (on & (k == x["modality"])).cast("bigint"))
        end = (F.floor(s["cursor"] / ITEMS).cast("int") + 1) * ITEMS
        yes = lambda c: F.coalesce(c, F.lit(False))
        create, answer, skip, ratings, counts = map(yes, (create, answer, skip, ratings, counts))
        return F.struct(
            (s["created"] | create).alias("created"), F.when(create, yes(x["is_human"])).otherwise(s["human"]).alias("human"),
            F.when(answer, s["cursor"] + 1).when(skip, end).otherwise(s["cursor"]).alias("cursor"),
            plus(s["right"], counts & yes(x["correct"])).alias("right"), plus(s["wrong"], counts & ~yes(x["correct"])).alias("wrong"),
            F.when(skip, F.concat(s["skipped"], F.sequence(s["cursor"], F.greatest(end - 1, s["cursor"])))).otherwise(s["skipped"]).alias("skipped"),
            F.when(ratings, x["ratings"]).otherwise(s["ratings"]).alias("ratings"), (s["completed"] | ratings).alias("completed"),
            (s["refused"] + (~(create | answer | skip | ratings)).cast("bigint")).alias("refused"),
        )

    out = log.groupBy(key).agg(F.aggregate(e, start, step).alias("_s")).select(key, "_s.*")
    return out.select(key, "created", "human", F.col("cursor").cast("bigint").alias("cursor"), "right", "wrong", "skipped", "ratings", "completed", "refused")


def resolved_shape(requested: Column, asked: Column, first: Column, present: Column) -> Column:
    """The shape that a sound reference is made for: the one requested, else the one asked about, else the first; null if the scene (array of ids) lacks it."""
    chosen = F.coalesce(requested, asked, first)
    return F.when(F.array_contains(present, chosen), chosen)


def allowed(requests: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("seed", "difficulty", "modality", "scene_index"), session: str = "session_id") -> DataFrame:
    """requests for data with `allowed`: whether all keys are those of their session's current item (current: session and keys)."""
    now = current.select(F.col(session).alias("_session"), *(F.col(k).alias(f"_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return requests.join(now, F.col(session) == F.col("_session"), "left").withColumn("allowed", F.col("_session").isNotNull() & same).drop("_session", *(f"_{k}" for k in keys))


def navigation(item: Column) -> dict[str, Column]:
    """Where an item stands: its block with first and last item, the number of its task from 1, its place in the block, and where the next block begins."""
    b = sessions.block(item, ITEMS, PRACTICE)
    return {**b, "task": b["block"] + 1, "local": (item % ITEMS).cast("bigint"), "next_start": F.least(b["end_item"], F.lit(len(MODALITIES) * ITEMS)).cast("bigint")}




#: How modalities, levels and questions are shown.
SHOWN = {
    "image": "Image", "video": "Video", "text": "Text", "tabular": "Tabular", "sound": "Sound", "easy": "Easy", "medium": "Medium", "hard": "Hard",
    "oqp": "Ordered quadrant passage", "xct": "Crossing count", "zqh": "Quadrant after moves", "lme": "Largest motion shape",
}


def shown(code: Column) -> Column:
    """The name under which a modality, level or question is shown; null for another code. Case and outer blanks don't matter."""
    return F.try_element_at(F.create_map(*(F.lit(x) for item in SHOWN.items() for x in item)), F.lower(F.trim(code)))


def whole_numbers(raw: Column) -> Column:
    """A list of whole numbers kept as text (JSON), as an array; null if it is anything else."""
    return F.when(raw.rlike(r"^\s*\[\s*(-?[0-9]{1,9}(\s*,\s*-?[0-9]{1,9})*)?\s*\]\s*$"), F.from_json(raw, "array<int>"))


def migrated(rows: DataFrame) -> DataFrame:
    """Session rows of the older form in the newer: the cursor is what current_item_index says, which is dropped, and skipped_questions is there, empty if it was not."""
    if "current_item_index" in rows.columns:
        rows = rows.withColumn("next_question_index", F.coalesce("current_item_index", "next_question_index") if "next_question_index" in rows.columns else F.col("current_item_index")).drop("current_item_index")
    empty = F.array().cast("array<int>")
    return rows.withColumn("skipped_questions", F.coalesce("skipped_questions", empty) if "skipped_questions" in rows.columns else empty)


def loaded(session_ids: DataFrame, stored: DataFrame, key: str = "session_id") -> DataFrame:
    """session_ids with `persisted`: whether a session has a stored state."""
    there = stored.select(key).distinct().withColumn("persisted", F.lit(True))
    return session_ids.join(there, key, "left").withColumn("persisted", F.coalesce("persisted", F.lit(False)))


def stimulus(plan: DataFrame, artifacts: DataFrame, is_human: bool) -> DataFrame:
    """What each item shows: plan (modality, scene_id) with the files of its modality: media_type, and content (an array of files in order, a film's frames); for texts and tables `body`.

    People see a text with the sentences about pairs, models without the pairs; both without its header. A table is shown as it is.
    """
    kind = {"image": "image", "video": "video", "text": "text", "tabular": "tabular", "sound": "sound"}
    media = F.create_map(*(F.lit(x) for k, v in (("image", "image/png"), ("video", "image/png"), ("text", "text/plain"), ("tabular", "text/csv"), ("sound", "audio/wav")) for x in (k, v)))
    of = artifacts.where(F.col("kind").isin(*kind)).groupBy("kind", "scene_id").agg(F.array_sort(F.collect_list(F.struct("name", "content"))).alias("_files"))
    out = plan.join(of.withColumnRenamed("kind", "modality"), ["modality", "scene_id"], "left")
    text = F.get("_files", 0)["content"].cast("string")
    body = F.when(F.col("modality") == "text", sentences.trimmed(text, is_human)).when(F.col("modality") == "tabular", text)
    return out.withColumn("media_type", F.element_at(media, F.col("modality"))).withColumn("content", F.transform("_files", lambda f: f["content"])).withColumn("body", body).drop("_files")


def data_uri(media_type: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.base64(content))


def reference_motions(spark, shape_type: str, color: str) -> DataFrame:
    """Scenes of one motion each, from quadrant to next quadrant, centre to centre: what a sound reference is made of (four rows, scene_index 0 to 3)."""
    centres = [geometry.CENTRES[q] for q in range(4)]
    rows = []
    for i in range(4):
        (x0, y0), (x1, y1) = centres[i], centres[(i + 1) % 4]
        rows.append((i, f"{i:032x}", [(0, shape_type, color)], [(0, 0, x0, y0, x1, y1)], [(0, 0, 0, 0, 0, 24)]))
    return spark.createDataFrame(rows, scenes.SCHEMA)
