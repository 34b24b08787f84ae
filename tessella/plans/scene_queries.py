"""The plans of a dataset as queries over generated scenes. Their SQL gets the scenes' raw rows as values and derives all else on its own."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, sentences
from ..operators import checks, graph, runs, sessions
from ..sources import scenes
from ..sources.config import Config
from . import dataset, evaluation, pictures
from .catalogue import _SIG, _TAN, _axis, _mix_sql, query, r6

COUNT, PER_EVENT = 16, 6
_CONFIG = Config.from_toml()
_SCENE = _CONFIG["scene"]


def _scenes(spark: SparkSession, count: int = COUNT) -> tuple[DataFrame, Config]:
    return scenes.generate(spark, _CONFIG, count), _CONFIG


def _values(rows: list[tuple]) -> str:
    # An exponent makes a number a double in SQL, with all its digits.
    shown = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) and "e" not in repr(v) else repr(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


@lru_cache(maxsize=4)
def _base(count: int = COUNT) -> str:
    """The raw rows of the first scenes as common tables: ways, ev, who; and mo, the events with their ends and shapes."""
    made = [scenes.one(_CONFIG, i) for i in range(count)]
    ways = [(m["scene_index"], w["shape_index"], w["segment"], w["x0"], w["y0"], w["x1"], w["y1"]) for m in made for w in m["waypoints"]]
    events = [(m["scene_index"], e["list_pos"], e["global_event_index"], e["time_slot"], e["shape_index"], e["shape_event_index"]) for m in made for e in m["events"]]
    who = [(m["scene_index"], s["shape_index"], s["shape_type"], s["color"]) for m in made for s in m["identities"]]
    return f"""ways(scene, shape, seg, x0, y0, x1, y1) AS ({_values(ways)}), ev(scene, pos, event, slot, shape, nth) AS ({_values(events)}), who(scene, shape, kind, colour) AS ({_values(who)}),
mo AS (SELECT ev.*, kind, colour, x0, y0, x1, y1 FROM ev JOIN ways ON ways.scene = ev.scene AND ways.shape = ev.shape AND seg = nth JOIN who ON who.scene = ev.scene AND who.shape = ev.shape)"""


_EASE = "(CASE WHEN {t} < 0.5 THEN 2.0 * {t} * {t} ELSE 1.0 - (2.0 - 2.0 * {t}) * (2.0 - 2.0 * {t}) / 2.0 END)"
_QUAD = "CASE WHEN {y} >= 0 THEN CASE WHEN {x} < 0 THEN 1 ELSE 0 END WHEN {x} <= 0 THEN 2 ELSE 3 END"
_BEND = 0.12 * (_SCENE["trajectory_complexity"] - 1)
_PATH = f"""pts AS (SELECT scene, shape, seg * {PER_EVENT} + k AS step, k, k / {PER_EVENT}.0::DOUBLE AS t, seg, x0, y0, x1, y1, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM ways, range({PER_EVENT + 1}) r(k) WHERE seg = 0 OR k > 0),
side AS (SELECT *, CASE WHEN k > 0 AND k < {PER_EVENT} AND len > 0 THEN CASE WHEN seg % 2 = 0 THEN 1.0 ELSE -1.0 END * {_BEND}e0 * sin(3.141592653589793 * t) ELSE 0.0 END AS s, CASE WHEN len > 0 THEN len ELSE 1.0 END AS u FROM pts),
xy AS (SELECT scene, shape, step, least(greatest(x0 + (x1 - x0) * t - (y1 - y0) / u * s, -1.0), 1.0) AS x, least(greatest(y0 + (y1 - y0) * t + (x1 - x0) / u * s, -1.0), 1.0) AS y FROM side),
uv AS (SELECT *, {_axis(_SIG, 'x')} AS u, {_axis(_TAN, 'y')} AS v FROM xy),
q AS (SELECT *, u * v AS q1, (1 - u) * v AS q2, (1 - u) * (1 - v) AS q3, u * (1 - v) AS q4 FROM uv),
dom AS (SELECT *, CASE WHEN q1 >= q2 AND q1 >= q3 AND q1 >= q4 THEN 0 WHEN q2 >= q3 AND q2 >= q4 THEN 1 WHEN q3 >= q4 THEN 2 ELSE 3 END AS d FROM q),
run AS (SELECT *, sum(CASE WHEN b IS NULL OR b = d THEN 0 ELSE 1 END) OVER (PARTITION BY scene, shape ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(d) OVER (PARTITION BY scene, shape ORDER BY step) AS b FROM dom))"""
_RANK = """cls AS (SELECT kind || '_' || colour AS id, (rank() OVER (ORDER BY code) - 1)::BIGINT AS r FROM (SELECT s.n AS kind, c.n AS colour, (s.i * 8) + c.b AS code FROM
  (VALUES ('circle', 1), ('star', 2), ('triangle', 3), ('square', 4), ('pentagon', 5), ('hexagon', 6)) s(n, i), (VALUES ('red', 4), ('green', 2), ('blue', 1), ('yellow', 6), ('magenta', 5), ('cyan', 3)) c(n, b)))"""
_SEED = f"xor(xor((scene + {_CONFIG['master_seed']})::UBIGINT, ((shape::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT), {identity.QUERY_SALT}::UBIGINT)"
_TARGETS = f"""{_PATH}, {_RANK},
src AS (SELECT scene * 100 + shape AS k, count(*) AS n, any_value({_SEED}) AS s FROM ev GROUP BY scene, shape), mixed AS ({_mix_sql('s')}),
nth_ AS (SELECT mo.*, row_number() OVER (PARTITION BY scene, shape ORDER BY nth, event) AS move FROM mo),
far AS (SELECT scene, arg_max(r, (d2, -r)) AS r FROM (SELECT scene, r, round((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0), 12) AS d2 FROM mo JOIN cls ON cls.id = kind || '_' || colour) GROUP BY scene),
t AS (
  SELECT scene, format('oqp{{:04d}}', shape) AS task_id, run::BIGINT AS segment_index, [avg(q1), avg(q2), avg(q3), avg(q4)] AS v FROM run GROUP BY scene, shape, run
  UNION ALL SELECT scene, format('xct{{:04d}}', shape), 0, [max(run)::DOUBLE] FROM run GROUP BY scene, shape
  UNION ALL SELECT scene, format('zqh{{:04d}}', shape), 0, [move::DOUBLE, ({_QUAD.format(x="x1", y="y1")})::DOUBLE] FROM nth_ JOIN mixed ON k = scene * 100 + shape WHERE move - 1 = (h % n::UBIGINT)::BIGINT
  UNION ALL SELECT scene, 'lme', 0, [r::DOUBLE] FROM far)"""


@query(f"WITH {_base()}, {_TARGETS} SELECT scene::BIGINT AS scene_index, task_id, segment_index, place, round(v[place + 1], 6) + 0.0 AS value FROM (SELECT *, unnest(range(len(v))) AS place FROM t)")
def scene_targets(spark, sf_dir):
    made, config = _scenes(spark)
    t = dataset.targets(made, config, PER_EVENT).select("scene_index", "task_id", F.col("segment_index").cast("bigint").alias("segment_index"), F.posexplode("values").alias("place", "value"))
    return t.select("scene_index", "task_id", "segment_index", F.col("place").cast("bigint").alias("place"), r6(F.col("value")).alias("value"))


@query(f"WITH {_base()}, {_TARGETS}, n AS (SELECT scene, task_id, count(*) AS segments, sum(len(v)) AS vals FROM t GROUP BY scene, task_id) SELECT scene::BIGINT AS scene_index, count(*) AS target_count, sum(segments)::BIGINT AS total_segments, sum(vals)::BIGINT AS total_values FROM n GROUP BY scene")
def scene_target_reports(spark, sf_dir):
    made, config = _scenes(spark)
    t = dataset.targets(made, config, PER_EVENT)
    return t.groupBy("scene_index").agg(F.countDistinct("task_id").alias("target_count"), F.count("*").alias("total_segments"), F.sum(F.size("values")).alias("total_values"))


@query(f"""WITH {_base()}, {_TARGETS}, bad AS (SELECT scene, task_id, segment_index, CASE WHEN scene = 3 AND task_id = 'xct0000' THEN ['nan'::DOUBLE] WHEN scene = 4 AND task_id = 'oqp0001' THEN list_transform(v, lambda x: x * 2) ELSE v END AS v FROM t WHERE NOT (scene = 2 AND task_id = 'lme') AND NOT (scene = 5 AND task_id = 'oqp0002' AND segment_index = 0)
  UNION ALL SELECT 1, 'abc0000', 0, [1.0])
SELECT scene::BIGINT AS scene_index, task_id, fault FROM (
  SELECT scene, task_id, 'sum' AS fault FROM bad WHERE starts_with(task_id, 'oqp') GROUP BY scene, task_id HAVING bool_or(abs(list_sum(v) - 1.0) > 1e-9)
  UNION ALL SELECT scene, task_id, 'range' FROM bad WHERE starts_with(task_id, 'oqp') GROUP BY scene, task_id HAVING bool_or(list_max(v) > 1.0)
  UNION ALL SELECT DISTINCT scene, task_id, 'not finite' FROM bad WHERE len(list_filter(v, lambda x: isnan(x))) > 0
  UNION ALL SELECT scene, task_id, 'segments' FROM bad GROUP BY scene, task_id HAVING min(segment_index) <> 0
  UNION ALL SELECT 2, 'lme', 'missing' UNION ALL SELECT 1, 'abc0000', 'unexpected'
  UNION ALL SELECT 5, 'oqp0002', 'missing' WHERE NOT EXISTS (SELECT 1 FROM bad WHERE scene = 5 AND task_id = 'oqp0002'))""")
def scene_target_faults(spark, sf_dir):
    """Targets that were tampered with, and the faults that are found: a target and a segment are left out, one is doubled, one is no number, one is unasked for."""
    made, config = _scenes(spark)
    s, k = F.col("scene_index"), F.col("task_id")
    t = dataset.targets(made, config, PER_EVENT).where(~((s == 2) & (k == "lme")) & ~((s == 5) & (k == "oqp0002") & (F.col("segment_index") == 0)))
    values = F.when((s == 3) & (k == "xct0000"), F.array(F.lit(float("nan")))).when((s == 4) & (k == "oqp0001"), F.transform("values", lambda v: v * 2)).otherwise(F.col("values"))
    bad = t.withColumn("values", values).union(spark.sql("SELECT 1L, 'abc0000', 0, array(1.0D)"))
    asked = made.select("scene_index").crossJoin(F.broadcast(dataset.expected_tasks(spark, _SCENE["n_shapes"])))
    return checks.target_faults(bad, asked, ["scene_index"])


@query(f"WITH {_base()}, {_RANK} SELECT s.scene::BIGINT AS scene_index, k.task_id, k.place::BIGINT AS place FROM (SELECT DISTINCT scene FROM ev) s, (SELECT format('{{}}{{:04d}}', ['oqp', 'xct', 'zqh'][j + 1], i) AS task_id, i * 3 + j AS place FROM range({_SCENE['n_shapes']}) a(i), range(3) b(j) UNION ALL SELECT 'lme', {3 * _SCENE['n_shapes']}) k")
def expected_task_ids(spark, sf_dir):
    made, _ = _scenes(spark)
    return made.select("scene_index").crossJoin(F.broadcast(dataset.expected_tasks(spark, _SCENE["n_shapes"])))


_THREE = "format('{{:.3f}}', CASE WHEN {v} >= 0 THEN ceil({v} * 1000.0) ELSE floor({v} * 1000.0) END / 1000.0 + 0.0)"
_CSV_LINE = "lpad(lower(to_hex(scene::UBIGINT)), 32, '0') || ',' || event || ',' || kind || ',' || colour || ',' || " + " || ',' || ".join(_THREE.format(v=c) for c in ("x0", "y0", "x1", "y1"))


@query(f"""WITH {_base()}, peers AS (SELECT a.scene, a.event, coalesce(string_agg(b.event::VARCHAR, '|' ORDER BY b.event), '') AS peers FROM ev a LEFT JOIN ev b ON a.scene = b.scene AND a.slot = b.slot AND a.event <> b.event GROUP BY a.scene, a.event)
SELECT scene::BIGINT AS scene_index, 'scene_id,event_index,shape_type,color,start_x,start_y,end_x,end_y,simultaneous_event_ids' || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) AS csv
FROM (SELECT scene, pos, {_CSV_LINE.replace("{{", "{").replace("}}", "}")} || ',' || peers AS line FROM mo JOIN peers USING (scene, event)) GROUP BY scene""")
def scene_tables(spark, sf_dir):
    made, config = _scenes(spark)
    return dataset.csv_lines(dataset.tabular(made, config))


_NAMES = "(['top right', 'top left', 'bottom left', 'bottom right'])"
_TEXT_QUAD = "CASE WHEN {y} >= 0 THEN CASE WHEN {x} < 0 THEN 1 ELSE 0 END WHEN {x} < 0 THEN 2 ELSE 3 END"
_LIST = "CASE len({a}) WHEN 0 THEN '' WHEN 1 THEN {a}[1] WHEN 2 THEN {a}[1] || ' and ' || {a}[2] ELSE array_to_string({a}[1:len({a}) - 1], ', ') || ', and ' || {a}[len({a})] END"
_FRAMES = max(_SCENE["event_duration_frames"], 2)
_TEXT = f"""quads AS (SELECT mo.*, list_transform(range({_FRAMES}), lambda i: {_EASE.format(t=f"(i / {_FRAMES - 1}.0::DOUBLE)")}) AS ts FROM mo),
walked AS (SELECT *, list_transform(ts, lambda t: {_TEXT_QUAD.format(x="(x0 + (x1 - x0) * t)", y="(y0 + (y1 - y0) * t)")}) AS qs FROM quads),
path AS (SELECT *, list_filter(qs, lambda z, i: i = 1 OR z <> qs[i - 1]) AS p FROM walked),
names AS (SELECT *, list_transform(p, lambda z: {_NAMES}[z + 1] || ' quadrant') AS n FROM path),
mates AS (SELECT a.scene, a.event, list('Event ' || lpad(b.event::VARCHAR, 4, '0') ORDER BY b.event) AS m FROM ev a JOIN ev b ON a.scene = b.scene AND a.slot = b.slot AND a.event <> b.event GROUP BY a.scene, a.event),
told AS (SELECT scene, event + 1 AS line_no, 'Event ' || lpad(event::VARCHAR, 4, '0') || ': ' || colour || ' ' || kind || ' shape moved ' ||
  CASE len(n) WHEN 1 THEN 'within ' || n[1] WHEN 2 THEN 'from ' || n[1] || ' to ' || n[2] ELSE 'from ' || n[1] || ' to ' || n[len(n)] || ' through ' || {_LIST.format(a="(n[2:len(n) - 1])")} END || '.' ||
  CASE WHEN m IS NULL THEN '' ELSE ' This happened at the same time as ' || {_LIST.format(a="m")} || '.' END AS line FROM names LEFT JOIN mates USING (scene, event)),
known AS (SELECT m.scene, m.event, w.shape, w.kind || '_' || w.colour AS name, coalesce(
    (SELECT arg_max({{'x': e.x1, 'y': e.y1}}, e.event) FROM mo e WHERE e.scene = m.scene AND e.shape = w.shape AND e.event <= m.event),
    (SELECT any_value({{'x': e.x0, 'y': e.y0}}) FROM mo e WHERE e.scene = m.scene AND e.shape = w.shape AND e.nth = 0)) AS at FROM ev m JOIN who w ON w.scene = m.scene),
pairs AS (SELECT a.scene, row_number() OVER (PARTITION BY a.scene ORDER BY a.event, a.shape, b.shape) - 1 AS pair, a.event, a.name AS an, b.name AS bn, a.at AS p, b.at AS r FROM known a JOIN known b ON a.scene = b.scene AND a.event = b.event AND a.shape < b.shape WHERE a.at IS NOT NULL AND b.at IS NOT NULL),
related AS (SELECT *, CASE WHEN p.x < r.x THEN 'left of' WHEN p.x > r.x THEN 'right of' ELSE 'aligned horizontally with' END AS h, CASE WHEN p.y > r.y THEN 'above' WHEN p.y < r.y THEN 'below' ELSE 'aligned vertically with' END AS v FROM pairs)"""


@query(f"""WITH {_base()}, {_TEXT}
SELECT scene::BIGINT AS scene_index, line_no::BIGINT AS line_no, line FROM (
  SELECT scene, 0 AS line_no, 'Scene ' || lpad(lower(to_hex(scene::UBIGINT)), 32, '0') || ': ' || count(*) || ' motion events.' AS line FROM ev GROUP BY scene
  UNION ALL SELECT scene, line_no, line FROM told
  UNION ALL SELECT scene, pair + 1000000, 'Pair ' || lpad(pair::VARCHAR, 4, '0') || ': [event ' || lpad(event::VARCHAR, 4, '0') || '] ' || an || ' is ' || h || ' ' || bn || ' and is ' || v || ' ' || bn || '.' FROM related)""")
def scene_sentences(spark, sf_dir):
    made, config = _scenes(spark)
    return dataset.text(made, config)


_MEANING = f"""WITH {_base()}, {_TEXT}
SELECT scene::BIGINT AS scene_index, 'event' AS kind, event::BIGINT AS place, kind || '_' || colour AS first, '' AS second, p[1]::BIGINT AS one, p[len(p)]::BIGINT AS two FROM path
UNION ALL SELECT scene, 'pair', pair, an, bn, CASE h WHEN 'left of' THEN 0 WHEN 'right of' THEN 1 ELSE 2 END, CASE v WHEN 'above' THEN 0 WHEN 'below' THEN 1 ELSE 2 END FROM related
UNION ALL SELECT scene, 'header', 0, lpad(lower(to_hex(scene::UBIGINT)), 32, '0'), '', count(*), 0 FROM ev GROUP BY scene"""


def _meaning(decoded: DataFrame) -> DataFrame:
    w = lambda c: F.col(f"what.{c}")
    none = F.lit("")
    return decoded.select(
        "scene_index", "kind", "place", F.coalesce(w("scene_id"), w("shape_id"), w("first"), none).alias("first"), F.coalesce(w("second"), none).alias("second"),
        F.coalesce(w("events"), w("start_quadrant"), w("horizontal")).cast("bigint").alias("one"), F.coalesce(w("end_quadrant"), w("vertical"), F.lit(0)).cast("bigint").alias("two"),
    )


@query(_MEANING)
def scene_meaning(spark, sf_dir):
    """What is read back from the scenes' texts; the SQL has it from the scenes."""
    made, config = _scenes(spark)
    return _meaning(sentences.decoded(spark, dataset.text(made, config)))


@query(_MEANING)
def scene_meaning_of_varied_text(spark, sf_dir):
    """As scene_meaning, from texts with synonyms and in the other order of clauses."""
    made, config = _scenes(spark)
    return _meaning(sentences.decoded(spark, dataset.text(made, config.replaced(scene__text_synonym_rate=0.7), peers_first=True, vertical_first=True)))


_SLOTS, _DURATION = _SCENE["n_motion_slots"], _SCENE["event_duration_frames"]
_FILM = f"""slots AS (SELECT w.scene, w.shape, s.slot, x0, y0, x1, y1 FROM who w, range({_SLOTS}) s(slot) LEFT JOIN mo ON mo.scene = w.scene AND mo.shape = w.shape AND mo.slot = s.slot),
held AS (SELECT *, coalesce(x0, last_value(x1 IGNORE NULLS) OVER b, first_value(x0 IGNORE NULLS) OVER a) AS fx, coalesce(y0, last_value(y1 IGNORE NULLS) OVER b, first_value(y0 IGNORE NULLS) OVER a) AS fy FROM slots
  WINDOW b AS (PARTITION BY scene, shape ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY scene, shape ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
film AS (SELECT scene, shape, slot, k AS frame, fx + (coalesce(x1, fx) - fx) * e AS x, fy + (coalesce(y1, fy) - fy) * e AS y FROM (SELECT held.*, k, {_EASE.format(t=f"(k / {_DURATION - 1}.0::DOUBLE)")} AS e FROM held, range({_DURATION}) f(k)) WHERE fx IS NOT NULL)"""


@query(f"WITH {_base()}, {_FILM} SELECT scene::BIGINT AS scene_index, shape::BIGINT AS shape_index, count(*) AS frames, round(avg(x), 6) + 0.0 AS mean_x, round(avg(y), 6) + 0.0 AS mean_y, round(max(x * frame), 6) + 0.0 AS late_x FROM film GROUP BY scene, shape")
def scene_frames(spark, sf_dir):
    made, config = _scenes(spark)
    f = dataset.frames(made, config).groupBy("scene_index", F.col("shape_index").cast("bigint").alias("shape_index"))
    return f.agg(F.count("*").alias("frames"), r6(F.avg("x")).alias("mean_x"), r6(F.avg("y")).alias("mean_y"), r6(F.max(F.col("x") * F.col("frame"))).alias("late_x"))


def _px(v: str) -> str:
    return f"least(greatest(round(({v}) * 63), 0), 63)"


@query(f"WITH {_base(4)}, {_FILM} SELECT scene::BIGINT AS scene_index, (slot * {_DURATION} + frame)::BIGINT AS frame, string_agg({_px('(x + 1.0) * 0.5')}::BIGINT || ':' || {_px('1.0 - (y + 1.0) * 0.5')}::BIGINT, ',' ORDER BY shape) AS dots FROM film GROUP BY scene, slot, frame")
def film_dots(spark, sf_dir):
    """Where the dots of the shapes stand in the frames of films of 64 pixels; films draws them there."""
    from ..functions import geometry

    made, config = _scenes(spark, 4)
    x, y = geometry.pixel(F.col("x"), F.col("y"), 64)
    dot = F.concat_ws(":", x.cast("bigint"), y.cast("bigint"))
    f = dataset.frames(made, config).groupBy("scene_index", (F.col("time_slot") * _DURATION + F.col("frame")).cast("bigint").alias("frame"))
    return f.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shape_index", dot.alias("d")))), lambda s: s["d"]), ",").alias("dots"))


@query()
def scene_films(spark, sf_dir):
    made, config = _scenes(spark, 2)
    f = pictures.films(made, config.replaced(scene__resolution=64, scene__event_duration_frames=3))
    return f.select("scene_index", "frame", F.length("png").alias("bytes"), F.sha2("png", 256).alias("sha"))


@query()
def scene_comics(spark, sf_dir):
    made, config = _scenes(spark, 4)
    return pictures.comics(made, config.replaced(scene__resolution=192)).select("scene_index", F.length("png").alias("bytes"), F.sha2("png", 256).alias("sha"))


_SIDE = 512 // 4
_GAP = max(_SIDE // 8, 2)


@query(f"""WITH src AS (SELECT scene * 100 + slot AS k, 0 AS n, xor(xor((scene + {_CONFIG['master_seed']})::UBIGINT, 4294967296::UBIGINT), slot::UBIGINT) AS s FROM range({COUNT}) a(scene), range({_SLOTS}) b(slot)), m AS ({_mix_sql('s')}),
o AS (SELECT k // 100 AS scene, k % 100 AS slot, row_number() OVER (PARTITION BY k // 100 ORDER BY h % 1099511627776, k) - 1 AS place FROM m),
i AS (SELECT scene, bool_and(slot = place) AS same FROM o GROUP BY scene),
f AS (SELECT o.scene, slot, CASE WHEN same THEN (place + {_SLOTS - 1}) % {_SLOTS} ELSE place END AS place FROM o JOIN i USING (scene))
SELECT scene::BIGINT AS scene_index, slot::BIGINT AS time_slot, ((place % 4) * {_SIDE + _GAP} + {_GAP})::BIGINT AS x, ((place // 4) * {_SIDE + _GAP} + {_GAP})::BIGINT AS y FROM f""")
def panel_placement(spark, sf_dir):
    seed = F.col("scene_index") + F.lit(_CONFIG["master_seed"])
    made = spark.range(COUNT).withColumnRenamed("id", "scene_index").withColumn("places", pictures.panels(seed, _SLOTS, 512))
    return made.select("scene_index", F.posexplode("places").alias("slot", "p")).select("scene_index", F.col("slot").cast("bigint").alias("time_slot"), "p.x", "p.y")


_RATE, _FPS, _DEPTH = _SCENE["sound_sample_rate_hz"], _SCENE["sound_frames_per_second"], _SCENE["sound_modulation_depth_per_mille"] / 1000


@query(f"WITH {_base()}, s AS (SELECT scene, slot FROM ev GROUP BY scene, slot) SELECT scene::BIGINT AS scene_index, ({_SLOTS} * (({_DURATION} * {_RATE} + {_FPS - 1}) // {_FPS}))::BIGINT AS expected, NULL::VARCHAR AS fault FROM s GROUP BY scene")
def scene_sample_counts(spark, sf_dir):
    made, config = _scenes(spark)
    return checks.expected_samples(scenes.motion_events(made, config), _SLOTS, _RATE, _FPS, ["scene_index"])


@query(f"""SELECT user_id, (sum(least_) + (30 - count(*)) * arg_min(first_, slot))::BIGINT AS expected, max(fault) AS fault FROM (
  SELECT user_id, slot, ((min(d) * 8000 + 23) // 24) AS least_, ((arg_min(d, event_id) * 8000 + 23) // 24) AS first_, CASE WHEN min(d) <> max(d) THEN 'durations' WHEN min(d) < 1 THEN 'length' END AS fault
  FROM (SELECT user_id, event_id, hour(ts) AS slot, (10 + (event_id % 97 = 0)::INT)::BIGINT AS d FROM events) GROUP BY user_id, slot) GROUP BY user_id""")
def sound_durations(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.hour("ts").alias("time_slot"), (F.lit(10) + (F.col("event_id") % 97 == 0).cast("int")).cast("bigint").alias("duration_frames"))
    return checks.expected_samples(e, 30, 8000, 24, ["user_id"], order="event_id")


@query()
def scene_sound(spark, sf_dir):
    made, config = _scenes(spark, 4)
    return dataset.sound(made, config).select("scene_index", F.length("wav").alias("bytes"), F.sha2("wav", 256).alias("sha"))


@query(f"""WITH {_base()}, per_slot AS (SELECT scene, slot, count(DISTINCT shape) AS shapes FROM ev GROUP BY scene, slot),
a AS (SELECT scene, count(*) AS slots, count(*) FILTER (shapes > 1) AS shared, max(shapes) AS most FROM per_slot GROUP BY scene), b AS (SELECT scene, shape, count(*) AS n FROM ev GROUP BY scene, shape)
SELECT scene::BIGINT AS scene_index, slots AS time_slot_count, shared AS simultaneous_slot_count, most AS max_shapes_per_slot, (SELECT string_agg(n::VARCHAR, ',' ORDER BY shape) FROM b WHERE b.scene = a.scene) AS events_per_shape FROM a""")
def scene_inspection(spark, sf_dir):
    made, config = _scenes(spark)
    e = scenes.motion_events(made, config)
    slots = e.groupBy("scene_index", "time_slot").agg(F.countDistinct("shape_index").alias("shapes")).groupBy("scene_index").agg(F.count("*").alias("time_slot_count"), F.count_if(F.col("shapes") > 1).alias("simultaneous_slot_count"), F.max("shapes").alias("max_shapes_per_slot"))
    each = e.groupBy("scene_index", "shape_index").agg(F.count("*").alias("n")).groupBy("scene_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shape_index", "n"))), lambda x: x["n"].cast("string")), ",").alias("events_per_shape"))
    return slots.join(each, "scene_index")


@query(f"WITH {_base()} SELECT sum(n)::BIGINT AS generated, count(*)::BIGINT * {sum(_SCENE['motion_events_per_shape'])} AS expected, count(*) AS scenes FROM (SELECT scene, count(*) AS n FROM ev GROUP BY scene)")
def scene_event_totals(spark, sf_dir):
    made, config = _scenes(spark)
    n = scenes.motion_events(made, config).groupBy("scene_index").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("generated"), (F.count("*") * sum(_SCENE["motion_events_per_shape"])).alias("expected"), F.count("*").alias("scenes"))


GRAPH_SCENES = 32
_LATENT = f"""flat AS (SELECT scene, flatten(list([x0, y0, x1, y1] ORDER BY pos)) AS v FROM mo GROUP BY scene),
near AS (SELECT a.scene AS src, b.scene AS dst, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS d2 FROM flat a JOIN flat b ON a.scene <> b.scene),
knn AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= {_CONFIG['site_graph.site_k']}),
edges AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, 1.0 / (1.0 + min(d2)) AS weight FROM knn GROUP BY 1, 2)"""


def _site(spark: SparkSession) -> tuple[DataFrame, DataFrame, Config]:
    made, config = _scenes(spark, GRAPH_SCENES)
    flat = graph.cut(graph.padded(dataset.latents(made, config), "vector").select(F.col("scene_index").alias("id"), "vector"))
    return flat, graph.cut(graph.undirected(graph.knn(flat, "id", "vector", min(config["site_graph.site_k"], GRAPH_SCENES - 1)))), config


@query(f"WITH {_base(GRAPH_SCENES)}, {_LATENT} SELECT src::BIGINT AS src, dst::BIGINT AS dst, round(weight, 6) + 0.0 AS weight FROM edges")
def scene_graph_edges(spark, sf_dir):
    return _site(spark)[1].select("src", "dst", r6(F.col("weight")).alias("weight"))


@query(f"""WITH RECURSIVE {_base(GRAPH_SCENES)}, {_LATENT}, b AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
r AS (SELECT scene AS node, scene AS c FROM flat UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.node), d AS (SELECT scene, count(b.dst) AS degree FROM flat LEFT JOIN b ON b.src = scene GROUP BY scene)
SELECT (SELECT count(DISTINCT c) FROM (SELECT node, min(c) AS c FROM r GROUP BY node)) AS components, count(*) AS nodes, min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 6) + 0.0 AS mean_degree, (SELECT count(*) FROM edges) AS edges FROM d""")
def scene_graph_report(spark, sf_dir):
    flat, edges, _ = _site(spark)
    parts = graph.components(flat, edges, "id").agg(F.countDistinct("component").alias("components"))
    stats = graph.degree_stats(graph.degrees(flat, edges, "id")).withColumn("mean_degree", r6(F.col("mean_degree")))
    return parts.join(stats, F.lit(True)).join(edges.agg(F.count("*").alias("edges")), F.lit(True))


@query()
def scene_graph(spark, sf_dir):
    flat, edges, config = _site(spark)
    parts = graph.components(flat, edges, "id").agg(F.countDistinct("component").alias("components"))
    stats = graph.degree_stats(graph.degrees(flat, edges, "id"))
    return checks.graph_verdict(parts.join(stats, F.lit(True)).join(graph.lambda2(flat, edges, "id", config["site_graph.lambda2_iterations"]), F.lit(True)), config["site_graph.site_k"], config["site_graph.lambda2_min"]).withColumn("lambda2", r6(F.col("lambda2")))


def _salted(salt: int, place: str) -> str:
    return f"xor(xor(seed::UBIGINT, {salt}::UBIGINT), (({place}) * 256)::UBIGINT)"


_PLAN = f"""seeds AS (SELECT o_orderkey AS seed FROM orders),
ord AS (WITH src AS (SELECT seed * 8 + i AS k, 0 AS n, {_salted(evaluation.ORDER_SALT, 'i + 1')} AS s FROM seeds, range(5) r(i)), m AS ({_mix_sql('s')}) SELECT k // 8 AS seed, list(k % 8 ORDER BY h % 1099511627776, k) AS modalities FROM m GROUP BY k // 8),
que AS (WITH src AS (SELECT seed * 8 + i AS k, 0 AS n, {_salted(evaluation.QUESTION_SALT, 'i + 1')} AS s FROM seeds, range(5) r(i)), m AS ({_mix_sql('s')}) SELECT k // 8 AS seed, list((['oqp', 'xct', 'zqh', 'lme'])[(h % 4)::INT + 1] ORDER BY k) AS questions FROM m GROUP BY k // 8)"""


@query(f"""WITH {_PLAN}, p AS (SELECT seed, item, modalities[item // 7 + 1] AS c, questions FROM ord JOIN que USING (seed), range(35) r(item))
SELECT seed, item, (['image', 'video', 'text', 'tabular', 'sound'])[c + 1] AS modality, questions[c + 1] AS question, item % 7 < 2 AS practice, (seed // 65536) * 65536 + item AS scene_index,
  CASE WHEN questions[c + 1] <> 'lme' THEN (item % 7) % 3 END::BIGINT AS query_shape, CASE WHEN questions[c + 1] <> 'lme' THEN questions[c + 1] || lpad(((item % 7) % 3)::VARCHAR, 4, '0') ELSE 'lme' END AS task_id FROM p""")
def evaluation_items(spark, sf_dir):
    """The plans of sessions whose seeds are the order keys."""
    return evaluation.items(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seed")), 3)


@query(f"WITH {_PLAN} SELECT seed, array_to_string(modalities, ',') AS modality_order, array_to_string(modalities, ',') AS read_back FROM ord")
def modality_orders(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seed"))
    text = evaluation.order_text(evaluation.modality_order(F.col("seed")))
    return o.select("seed", text.alias("modality_order"), evaluation.order_text(evaluation.read_order(text)).alias("read_back"))


@query(f"""WITH {_base()}, {_TARGETS},
lab AS (SELECT scene, shape, kind || '_' || colour AS id, colour || ' ' || kind AS label, r FROM who JOIN cls ON cls.id = kind || '_' || colour),
opt AS (SELECT scene, string_agg(label, ', ' ORDER BY shape) AS options FROM lab GROUP BY scene),
ask AS (SELECT lab.scene, q, shape, CASE q WHEN 'lme' THEN 'lme' ELSE q || lpad(shape::VARCHAR, 4, '0') END AS task_id, label FROM lab, (VALUES ('oqp'), ('xct'), ('zqh'), ('lme')) k(q) WHERE q <> 'lme' OR shape = 0),
told AS (SELECT scene, task_id, string_agg((CASE WHEN v[1] >= v[2] AND v[1] >= v[3] AND v[1] >= v[4] THEN 1 WHEN v[2] >= v[3] AND v[2] >= v[4] THEN 2 WHEN v[3] >= v[4] THEN 3 ELSE 4 END)::VARCHAR, ',' ORDER BY segment_index) AS a, NULL AS m FROM t WHERE starts_with(task_id, 'oqp') GROUP BY scene, task_id
  UNION ALL SELECT scene, task_id, v[1]::BIGINT::VARCHAR, NULL FROM t WHERE starts_with(task_id, 'xct') UNION ALL SELECT scene, task_id, (v[2]::BIGINT + 1)::VARCHAR, v[1]::BIGINT FROM t WHERE starts_with(task_id, 'zqh')
  UNION ALL SELECT t.scene, task_id, arg_min(label, shape), NULL FROM t JOIN lab ON lab.scene = t.scene AND lab.r = t.v[1] WHERE task_id = 'lme' GROUP BY t.scene, task_id)
SELECT ask.scene::BIGINT AS scene_index, ask.task_id, a AS expected, CASE q WHEN 'oqp' THEN 'For the ' || label || ', list the ordered quadrant passage.' WHEN 'xct' THEN 'For the ' || label || ', how many total quadrant crossings occurred?'
  WHEN 'zqh' THEN 'For the ' || label || ', what quadrant is it in after it moved ' || m || ' times?' ELSE 'Which shape has traveled the longest distance in a single move between two points? Available options: ' || options || '.' END AS prompt
FROM ask JOIN told USING (scene, task_id) JOIN opt USING (scene)""")
def evaluation_answers(spark, sf_dir):
    """Prompts and expected answers of all questions about the first scenes."""
    made, config = _scenes(spark)
    ranks = identity.classes(spark).select("shape_id", "class_rank")
    who = made.select("scene_index", F.explode("identities").alias("s")).select("scene_index", "s.shape_index", F.concat_ws("_", "s.shape_type", "s.color").alias("shape_id")).join(F.broadcast(ranks), "shape_id")
    shapes = F.explode(F.sequence(F.lit(0), F.lit(_SCENE["n_shapes"] - 1)))
    plan = made.select("scene_index", shapes.alias("s")).select("scene_index", "s", F.explode(F.array(*map(F.lit, evaluation.QUESTIONS))).alias("question")).where("question <> 'lme' or s = 0")
    shape = F.when(F.col("question") != "lme", F.col("s").cast("bigint"))
    plan = plan.select("scene_index", "question", shape.alias("query_shape"), F.when(shape.isNotNull(), F.concat("question", F.lpad(F.col("s").cast("string"), 4, "0"))).otherwise("lme").alias("task_id"))
    return evaluation.answers(plan, dataset.targets(made, config, PER_EVENT), who).select("scene_index", "task_id", "expected", "prompt")


@query("SELECT range AS item, range // 7 AS block, (range // 7) * 7 AS first_item, (range // 7) * 7 + 7 AS end_item, range % 7 < 2 AS practice, range // 7 + 1 AS task, range % 7 AS local, least((range // 7) * 7 + 7, 35) AS next_start FROM range(35)")
def item_navigation(spark, sf_dir):
    return spark.range(35).select(F.col("id").alias("item"), *(c.alias(k) for k, c in evaluation.navigation(F.col("id")).items()))


@query(f"""WITH RECURSIVE log AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE event_type WHEN 'click' THEN 'skip' ELSE 'answer' END AS kind, (event_id % 4 > 0)::INT AS fits, value > 100 AS correct, event_id FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS c, 0::BIGINT AS r, 0::BIGINT AS w, 0::BIGINT AS bad FROM log WHERE i = 0
  UNION ALL SELECT f.user_id, f.i + 1, CASE WHEN ok AND kind = 'answer' THEN c + 1 WHEN ok THEN (c // 7 + 1) * 7 ELSE c END, r + (ok AND kind = 'answer' AND c % 7 >= 2 AND correct)::INT, w + (ok AND kind = 'answer' AND c % 7 >= 2 AND NOT correct)::INT, bad + (NOT ok)::INT
  FROM (SELECT f.*, log.kind, log.correct, f.c < 35 AND fits = 1 AS ok FROM f JOIN log ON log.user_id = f.user_id AND log.i = f.i) f)
SELECT user_id, max_by(c, i) AS cursor, max_by(r, i) AS right_answers, max_by(w, i) AS wrong_answers, max_by(bad, i) AS refused FROM f GROUP BY user_id""")
def session_states(spark, sf_dir):
    """Sessions folded from a log that is made of the events: a creation, then answers and skips, three of four of which name the session's own item if it is answered in order."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    rows = e.select("user_id", i.alias("i"), F.when(F.col("event_type") == "click", "skip").otherwise("answer").alias("kind"), (F.col("event_id") % 4 > 0).alias("fits"), (F.col("value") > 100).alias("correct"))
    none = F.lit(None)
    # The item that an event names is found by the same fold, so the log says "the session's own" or another by -1 and -2; state takes items, so they are filled in here.
    steps = F.array_sort(F.collect_list(F.struct("i", "kind", "fits", "correct")))
    start = F.struct(F.lit(0).alias("c"), F.array().cast("array<struct<i:bigint,kind:string,item:int,correct:boolean>>").alias("out"))

    def step(s, x):
        item = F.when(x["fits"] & (s["c"] < 35), s["c"]).otherwise(F.lit(-1))
        ok = item >= 0
        after = F.when(ok & (x["kind"] == "answer"), s["c"] + 1).when(ok, (F.floor(s["c"] / 7).cast("int") + 1) * 7).otherwise(s["c"])
        return F.struct(after.alias("c"), F.concat(s["out"], F.array(F.struct(x["i"].alias("i"), x["kind"].alias("kind"), item.alias("item"), x["correct"].alias("correct")))).alias("out"))

    filled = rows.groupBy("user_id").agg(F.explode(F.aggregate(steps, start, step, lambda s: s["out"])).alias("x")).select("user_id", "x.*")
    log = filled.select("user_id", F.col("i").alias("ts"), F.col("i").alias("event_id"), "kind", F.lit(True).alias("is_human"), "item", F.lit("text").alias("modality"), "correct", none.cast("array<int>").alias("ratings"))
    made = rows.select("user_id").distinct().select("user_id", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit("create"), F.lit(True), none.cast("int"), none.cast("string"), none.cast("boolean"), none.cast("array<int>"))
    out = evaluation.state(log.union(made), "user_id")
    return out.select("user_id", "cursor", F.element_at("right", "text").alias("right_answers"), F.element_at("wrong", "text").alias("wrong_answers"), "refused")


@query("SELECT user_id, event_id, user_id % 3 = event_id % 3 AND event_type = 'click' AS allowed FROM events")
def data_access(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    asked = e.select("user_id", "event_id", (F.col("event_id") % 3).alias("seed"), "event_type")
    now = e.select("user_id", (F.col("user_id") % 3).alias("seed"), F.lit("click").alias("event_type")).distinct()
    return evaluation.allowed(asked, now, ("seed", "event_type"), "user_id").select("user_id", "event_id", "allowed")


@query("SELECT o_orderkey, CASE WHEN regexp_full_match(w, '[a-z]+') THEN w END AS candidate FROM (SELECT o_orderkey, lower(trim(CASE o_orderkey % 3 WHEN 0 THEN ' ' || o_orderpriority ELSE o_orderstatus || ' ' END)) AS w FROM orders)")
def synonym_candidates(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise(F.concat("o_orderstatus", F.lit(" ")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", sentences.synonym_candidate(raw).alias("candidate"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'red circle' WHEN 1 THEN 'a b c' ELSE 'plain' END AS label FROM customer")
def natural_labels(spark, sf_dir):
    k = F.col("c_custkey") % 3
    shape = F.when(k == 0, "circle_red").when(k == 1, "a_b_c").otherwise("plain")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", sentences.natural_label(shape).alias("label"))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), t AS (SELECT o_custkey, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
SELECT t.o_custkey, t.o_orderkey AS taker, v.o_orderkey AS slot FROM t JOIN v ON t.o_custkey = v.o_custkey AND t.i = v.i""")
def dealt_slots(spark, sf_dir):
    """Each customer's order keys, sorted, dealt to the customer's orders by date."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate")
    out = runs.dealt(o.select("o_custkey", F.col("o_orderkey").alias("slot")), ["slot"], o, ["o_orderdate", "o_orderkey"], "slot", ["o_custkey"])
    return out.select("o_custkey", F.col("o_orderkey").alias("taker"), "slot")


PATHS = 100


@lru_cache(maxsize=4)
def _sampled(segments: int) -> str:
    rows = [(i, s, *a, *b) for i in range(PATHS) for s, a, b in scenes.random_way(_CONFIG["master_seed"], i, segments)]
    n = dataset.SEGMENT_POINTS
    return f"""SELECT *, u * v AS q1, (1 - u) * v AS q2, (1 - u) * (1 - v) AS q3, u * (1 - v) AS q4 FROM (SELECT *, {_axis(_SIG, 'x')} AS u, {_axis(_TAN, 'y')} AS v FROM (
  SELECT i, x0 + (x1 - x0) * (k / {n}.0::DOUBLE) AS x, y0 + (y1 - y0) * (k / {n}.0::DOUBLE) AS y FROM ({_values(rows)}) w(i, s, x0, y0, x1, y1), range({n + 1}) r(k) WHERE s = 0 OR k > 0))"""


_CORNER = " OR ".join("(" + " + ".join(f"(q{j} - {float(i == j)}) * (q{j} - {float(i == j)})" for j in range(1, 5)) + ") < 0.01" for i in range(1, 5))
_DOMINANT = "CASE WHEN q1 >= q2 AND q1 >= q3 AND q1 >= q4 THEN 0 WHEN q2 >= q3 AND q2 >= q4 THEN 1 WHEN q3 >= q4 THEN 2 ELSE 3 END"


@query(f"""WITH a AS (SELECT avg(n) AS m FROM (SELECT i, count(DISTINCT {_DOMINANT}) AS n FROM ({_sampled(dataset.QUADRANT_SEGMENTS)}) GROUP BY i)), b AS (SELECT avg(c) AS r FROM (SELECT i, bool_or({_CORNER})::INT AS c FROM ({_sampled(dataset.CORNER_SEGMENTS)}) GROUP BY i))
SELECT round(m, 6) + 0.0 AS mean_quadrants, round(r, 6) + 0.0 AS corner_rate, CASE WHEN m < 2.0 THEN 'quadrants' WHEN r < 0.05 THEN 'corners' END AS fault FROM a, b""")
def landscape_check(spark, sf_dir):
    """The landscape of the default configuration on 100 sampled paths."""
    return dataset.landscape(spark, _CONFIG, PATHS).select(r6(F.col("mean_quadrants")).alias("mean_quadrants"), r6(F.col("corner_rate")).alias("corner_rate"), "fault")


@query(f"SELECT range::BIGINT AS scene_index, 2::BIGINT AS channels, {_RATE}::BIGINT AS rate, ({_SLOTS} * (({_DURATION} * {_RATE} + {_FPS - 1}) // {_FPS}))::BIGINT AS samples, NULL::VARCHAR AS fault FROM range(4)")
def scene_sound_check(spark, sf_dir):
    """What the sounds of scenes hold when they are read back."""
    made, config = _scenes(spark, 4)
    r = dataset.sound_report(made, config)
    return r.select("scene_index", F.col("channels").cast("bigint").alias("channels"), F.col("rate").cast("bigint").alias("rate"), "samples", "fault")


@query(f"WITH {_base()}, {_PATH} SELECT scene::BIGINT AS scene_index, count(*) AS points, count(*) AS with_quadrants, 0::BIGINT AS trajectory_only FROM xy GROUP BY scene")
def projection_switch(spark, sf_dir):
    """Points with soft quadrants, and without where only trajectories are wanted."""
    made, config = _scenes(spark)
    p = scenes.points(made, config, PER_EVENT)
    a = dataset.memberships(p, config).groupBy("scene_index").agg(F.count("*").alias("points"), F.count("q").alias("with_quadrants"))
    b = dataset.memberships(p, config, soft=False).groupBy("scene_index").agg(F.count("q").alias("trajectory_only"))
    return a.join(b, "scene_index")


@query("SELECT event_type, CASE lower(trim(event_type)) WHEN 'text' THEN 'Text' WHEN 'image' THEN 'Image' END AS shown, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN ' TEXT' WHEN 'view' THEN 'image' ELSE event_type END AS event_type FROM events) GROUP BY event_type")
def shown_names(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(F.col("event_type") == "click", " TEXT").when(F.col("event_type") == "view", "image").otherwise(F.col("event_type")).alias("event_type"))
    return e.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", evaluation.shown(F.col("event_type")).alias("shown"), "n")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey + (o_orderkey % 7) WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE NULL END::BIGINT AS total, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 END::BIGINT AS n FROM orders""")
def stored_number_lists(spark, sf_dir):
    """Lists of numbers that are kept as text: their sums and sizes; null for what is no list."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" ["), k.cast("string"), F.lit(", "), (k % 7).cast("string"), F.lit("]"))).when(k % 4 == 1, "[]").when(k % 4 == 2, "[1,]").otherwise("x")
    numbers = evaluation.whole_numbers(raw)
    total = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda t, x: t + x)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", total.alias("total"), F.when(numbers.isNotNull(), F.size(numbers)).cast("bigint").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_nationkey END::BIGINT AS next_question_index, 0::BIGINT AS skipped FROM customer")
def migrated_sessions(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old = c.select("c_custkey", F.col("c_custkey").alias("next_question_index"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey").cast("bigint")).alias("current_item_index"))
    new = evaluation.migrated(old)
    return new.select("c_custkey", F.col("next_question_index").cast("bigint").alias("next_question_index"), F.size("skipped_questions").cast("bigint").alias("skipped"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS persisted FROM customer")
def persisted_sessions(spark, sf_dir):
    c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    return evaluation.loaded(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(f"""WITH {_base()}, {_TEXT}, ev_ AS (SELECT scene, string_agg(line, chr(10) ORDER BY line_no) AS body FROM told GROUP BY scene),
pr AS (SELECT scene, string_agg('Pair ' || lpad(pair::VARCHAR, 4, '0') || ': [event ' || lpad(event::VARCHAR, 4, '0') || '] ' || an || ' is ' || h || ' ' || bn || ' and is ' || v || ' ' || bn || '.', chr(10) ORDER BY pair) AS body FROM related GROUP BY scene)
SELECT scene::BIGINT AS scene_index, is_human, CASE WHEN is_human THEN ev_.body || chr(10) || pr.body ELSE ev_.body END AS body, 'text/plain' AS media_type FROM ev_ JOIN pr USING (scene), (VALUES (true), (false)) h(is_human)""")
def text_stimuli(spark, sf_dir):
    """What people and models see of a scene's text."""
    made, config = _scenes(spark)
    files = dataset.text_files(dataset.text(made, config)).select(F.lit("text").alias("kind"), identity.scene_id(F.col("scene_index")).alias("scene_id"), F.lit("text").alias("name"), F.col("text").cast("binary").alias("content"))
    plan = made.select("scene_index", "scene_id", F.lit("text").alias("modality"))
    one = lambda human: evaluation.stimulus(plan, files, human).select("scene_index", F.lit(human).alias("is_human"), F.regexp_replace("body", "\\n$", "").alias("body"), "media_type")
    return one(True).union(one(False))


@query("SELECT r_regionkey::BIGINT AS r_regionkey, 'data:text/plain;base64,' || to_base64(r_name::BLOB) AS uri FROM region")
def data_uris(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    return r.select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), evaluation.data_uri(F.lit("text/plain"), F.col("r_name").cast("binary")).alias("uri"))


@query()
def reference_sounds(spark, sf_dir):
    made = evaluation.reference_motions(spark, "circle", "red")
    config = _CONFIG.replaced(scene__n_motion_slots=5)
    return dataset.sound(made, config).select("scene_index", F.length("wav").alias("bytes"), F.sha2("wav", 256).alias("sha"))


@query(f"""WITH {_base()} SELECT scene::BIGINT AS scene_index, pos::BIGINT AS list_pos, event::BIGINT AS event, slot::BIGINT AS slot, kind || '_' || colour AS shape_id, round(x0, 9) + 0.0 AS x0, round(y1, 9) + 0.0 AS y1 FROM mo""")
def generated_events(spark, sf_dir):
    """The events that executors generate; the SQL has the rows that the pure function of configuration and index gives."""
    made, config = _scenes(spark)
    e = scenes.motion_events(made, config)
    nine = lambda c: (F.round(c, 9) + F.lit(0.0)).alias
    return e.select("scene_index", F.col("list_pos").cast("bigint").alias("list_pos"), F.col("global_event_index").alias("event"), F.col("time_slot").alias("slot"), "shape_id", nine("start_x")("x0"), nine("end_y")("y1"))


@query(f"""WITH {_base()}, c AS (SELECT scene, shape, count(*) AS n, count(DISTINCT slot) AS slots, min(slot) >= 0 AND max(slot) < {_SLOTS} AS inside, list(slot ORDER BY nth) = list(slot ORDER BY slot) AS sorted FROM ev GROUP BY scene, shape)
SELECT scene::BIGINT AS scene_index, shape::BIGINT AS shape_index, n, ({_SCENE['motion_events_per_shape']})[shape + 1]::BIGINT AS asked, n = slots AND inside AND sorted AS slots_fine, (SELECT count(DISTINCT event) = count(*) AND max(event) = count(*) - 1 AND min(event) = 0 FROM ev e WHERE e.scene = c.scene) AS numbering_fine FROM c""")
def generation_rules(spark, sf_dir):
    """Of each shape: its events and how many were asked for, whether its slots are distinct, inside and in order, and whether its scene numbers its events without gap."""
    made, config = _scenes(spark)
    e = scenes.motion_events(made, config)
    in_order = F.array_sort(F.collect_list(F.struct("shape_event_index", "time_slot")))
    slots = F.transform(in_order, lambda x: x["time_slot"])
    fine = (F.countDistinct("time_slot") == F.count("*")) & (F.min("time_slot") >= 0) & (F.max("time_slot") < _SLOTS) & (slots == F.array_sort(slots))
    of_shape = e.groupBy("scene_index", "shape_index").agg(F.count("*").alias("n"), fine.alias("slots_fine"))
    numbered = runs.contiguous(e, ["scene_index"], "global_event_index").withColumnRenamed("contiguous", "numbering_fine")
    asked = F.get(F.array(*map(F.lit, _SCENE["motion_events_per_shape"])), F.col("shape_index")).cast("bigint")
    return of_shape.join(numbered, "scene_index").select("scene_index", F.col("shape_index").cast("bigint").alias("shape_index"), "n", asked.alias("asked"), "slots_fine", "numbering_fine")


@query("SELECT range AS scene_index, lpad(lower(to_hex(range::UBIGINT)), 32, '0') AS scene_id, CASE WHEN range < 17 THEN 0 WHEN range < 24 THEN 1 ELSE 2 END::BIGINT AS batch FROM range(10, 29)")
def scene_batches(spark, sf_dir):
    """Nineteen scenes from the tenth on, in batches of seven."""
    out = None
    for i, b in enumerate(scenes.batches(spark, _CONFIG, 7, 19, 10)):
        some = b.select("scene_index", "scene_id", F.lit(i).cast("bigint").alias("batch"))
        out = some if out is None else out.union(some)
    return out


def _through(codec):
    """Each user's points (id, rows) written by a codec and read again: (user_id, id, rows, width, total)."""
    import pandas as pd

    def run(frames):
        for f in frames:
            got = [codec(f"{u:032x}", [list(map(float, p)) for p in points]) for u, points in zip(f["user_id"], f["points"])]
            yield pd.DataFrame({"user_id": f["user_id"], "name": [g[0] for g in got], "n": [len(g[1]) for g in got], "total": [sum(map(sum, g[1])) for g in got]})

    return run


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: F.array(x["value"], x["event_id"].cast("double"))).alias("points"))


_CODED = "SELECT user_id, lpad(lower(to_hex(user_id::UBIGINT)), 32, '0') AS name, count(*)::BIGINT AS n, round(sum(value) + sum(event_id), 3) + 0.0 AS total FROM events GROUP BY user_id"


@query(_CODED)
def target_codec(spark, sf_dir):
    """Target files of all users' points, written and read back."""
    from ..sources import codecs

    def both(name, rows):
        scene, _, got = codecs.read_target(codecs.write_target(name, "oqp0000", rows))
        return scene, got

    out = _points(spark, sf_dir).mapInPandas(_through(both), "user_id bigint, name string, n bigint, total double")
    return out.withColumn("total", F.round("total", 3) + F.lit(0.0))


@query(_CODED)
def latent_codec(spark, sf_dir):
    """As target_codec, as one vector for each user."""
    from ..sources import codecs

    def both(name, rows):
        scene, got = codecs.read_latent(codecs.write_latent(name, [v for r in rows for v in r]))
        return scene, [got[i : i + 2] for i in range(0, len(got), 2)]

    out = _points(spark, sf_dir).mapInPandas(_through(both), "user_id bigint, name string, n bigint, total double")
    return out.withColumn("total", F.round("total", 3) + F.lit(0.0))


@query("SELECT user_id, lpad(lower(to_hex(user_id::UBIGINT)), 32, '0') AS name, count(*)::BIGINT AS n, sum(trunc(value))::DOUBLE + 0.0 AS total FROM events GROUP BY user_id")
def wav_codec(spark, sf_dir):
    """All users' values as 16-bit sounds, written and read back."""
    import numpy as np

    from ..sources import codecs

    def both(name, rows):
        rate, got = codecs.read_wav(codecs.write_wav(np.trunc(np.array([[r[0]] for r in rows])), 8000))
        return name if rate == 8000 else "", got.tolist()

    return _points(spark, sf_dir).mapInPandas(_through(both), "user_id bigint, name string, n bigint, total double").withColumn("total", F.col("total") + F.lit(0.0))


@query(f"WITH {_base(GRAPH_SCENES)}, {_LATENT} SELECT {GRAPH_SCENES}::BIGINT AS nodes, count(*) AS edges, round(sum(weight), 6) + 0.0 AS weight, round(sum(weight * (src * 100 + dst)), 4) + 0.0 AS places FROM edges")
def graph_codec(spark, sf_dir):
    """The site graph as a file, read back."""
    from ..sources import codecs

    _, edges, _ = _site(spark)
    rows = [(r.src, r.dst, r.weight) for r in edges.select("src", "dst", "weight").toLocalIterator()]
    nodes, got, _, _ = codecs.read_graph(codecs.write_graph(GRAPH_SCENES, rows, 0.5, (1, 2, 1.5)))
    out = spark.createDataFrame([(nodes, *e) for e in got], "nodes bigint, src bigint, dst bigint, weight double")
    return out.groupBy("nodes").agg(F.count("*").alias("edges"), r6(F.sum("weight")).alias("weight"), (F.round(F.sum(F.col("weight") * (F.col("src") * 100 + F.col("dst"))), 4) + F.lit(0.0)).alias("places"))


@query(f"WITH {_base()}, {_TARGETS} SELECT scene::BIGINT AS scene_index, count(*) AS files, sum(n)::BIGINT AS segments FROM (SELECT scene, task_id, count(*) AS n FROM t GROUP BY scene, task_id) GROUP BY scene")
def target_files(spark, sf_dir):
    """The target files of a dataset, and the segments that their heads tell."""
    made, config = _scenes(spark)
    files = dataset.artifacts(made, config, PER_EVENT).where("kind = 'target'")
    segments = F.conv(F.hex(F.reverse(F.substring(F.col("content"), 49, 4))), 16, 10).cast("bigint")
    return files.groupBy((F.conv("scene_id", 16, 10)).cast("bigint").alias("scene_index")).agg(F.count("*").alias("files"), F.sum(segments).alias("segments"))


_KINDS = "CASE event_type WHEN 'click' THEN 'initialize' WHEN 'error' THEN 'close' WHEN 'view' THEN 'rehydrate' ELSE 'seen' END"


@query(f"""WITH l AS (SELECT user_id, event_id, ts, {_KINDS} AS kind FROM events),
s AS (SELECT *, last_value(CASE WHEN kind IN ('initialize', 'close') THEN kind END IGNORE NULLS) OVER w AS state, max((kind = 'initialize')::INT) OVER w AS begun FROM l
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, bool_or(kind = 'initialize') AS initialized, coalesce(arg_max(state, (ts, event_id)), '') = 'close' AS closed, arg_max(event_id, (ts, event_id)) FILTER (kind = 'initialize')::VARCHAR AS payload,
  count(*) FILTER (kind = 'rehydrate' AND state = 'initialize') AS rehydrated, count(*) FILTER (kind = 'rehydrate' AND (state IS NULL OR state <> 'initialize')) AS refused FROM s GROUP BY user_id""")
def connection_states(spark, sf_dir):
    """Connections folded from the events: clicks initialise, errors close, views rehydrate."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.col("event_type")
    kind = F.when(t == "click", "initialize").when(t == "error", "close").when(t == "view", "rehydrate").otherwise("seen")
    return sessions.connections(e.select("user_id", "ts", "event_id", kind.alias("kind"), F.col("event_id").alias("payload")), "user_id", ["ts", "event_id"])


@query("""SELECT range AS i, (['circle', 'star', 'triangle', 'square', 'pentagon', 'hexagon'])[range + 1] AS shape_type, CASE WHEN range < 6 THEN (['red', 'green', 'blue', 'yellow', 'magenta', 'cyan'])[range % 6 + 1] END AS color FROM range(9)""")
def fixed_identities(spark, sf_dir):
    who = identity.fixed_identity(F.col("id"))
    return spark.range(9).select(F.col("id").alias("i"), who["shape_type"].alias("shape_type"), who["color"].alias("color"))
