"""The sentences that describe a scene: rendering, reading back, surface variation and its correction."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import QUADRANTS
from .identity import COLOURS, SHAPES

#: Relations between two shapes.
HORIZONTAL = ("left of", "right of", "aligned horizontally with")
VERTICAL = ("above", "below", "aligned vertically with")
#: The ways in which relations may be read.
HORIZONTAL_READ = {"to the left of": 0, "left of": 0, "leftward of": 0, "to the right of": 1, "right of": 1, "aligned horizontally with": 2, "horizontally aligned with": 2}
VERTICAL_READ = {"above": 0, "below": 1, "aligned vertically with": 2, "vertically aligned with": 2}
#: The small thesaurus of this package for the words that vary.
SYNONYMS = {"happened": ("occurred",), "moved": ("shifted", "travelled"), "relative": ("compared",), "same": ("identical",), "scene": ("picture",)}
#: Words that typing errors are put right to.
VOCABULARY = (
    "Scene", "Event", "Pair", "At", "This", "the", "as", "at", "of", "scene", "motion", "event", "events", "red", "green", "blue", "yellow",
    "magenta", "cyan", "circle", "star", "triangle", "square", "pentagon", "hexagon", "shape", "moved", "translated", "within", "from", "to",
    "quadrant", "through", "top", "bottom", "left", "right", "above", "below", "aligned", "horizontally", "vertically", "with", "relative", "center",
    "same", "time", "happened", "and", "is",
)
#: The keys next to each letter's on a keyboard.
KEYBOARD = {
    "q": "12wsa", "w": "q23edsa", "e": "w34rfds", "r": "e45tfd", "t": "r56ygf", "y": "67uhgt", "u": "78ijhy", "i": "89okju", "o": "90plki", "p": "0-[';lo", "a": "qwsz<", "s": "aqwedxz", "d": "erfcxsw",
    "f": "ertgvcd", "g": "tyhbvf", "h": "yujnbg", "j": "uikmnh", "k": "iol,mj", "l": "op;.,k", "z": "asx<", "x": "zsdc ", "c": "xdfv ", "v": "cfgb ", "b": "vghn ", "n": "bhjm ", "m": "njk, ",
}


def keyboard_neighbours() -> dict[str, str]:
    """The letters next to each letter, either way round, sorted."""
    return {a: "".join(sorted({b for b in KEYBOARD if b != a and (b in KEYBOARD[a] or a in KEYBOARD[b])})) for a in KEYBOARD}


def english_list(items: Column) -> Column:
    """"", "a", "a and b", "a, b, and c"."""
    n = F.size(items)
    return F.when(n <= 2, F.array_join(items, " and ")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.get(items, n - 1)))


def _named(index: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, names)), index)


def shape_label(shape_id: Column) -> Column:
    """type_color as "color type shape"; other ids as they are."""
    at = F.instr(shape_id, "_")
    return F.when(at > 0, F.concat(F.substring(shape_id, at + 1, F.length(shape_id)), F.lit(" "), F.substring(shape_id, F.lit(1), at - 1), F.lit(" shape"))).otherwise(shape_id)


def read_shape_label(label: Column) -> Column:
    """The id of "color type shape"; null for anything else."""
    m = r"^\s*(\S+)\s+(\S+) shape\s*$"
    return F.when(label.rlike(m), F.concat(F.regexp_extract(label, m, 2), F.lit("_"), F.regexp_extract(label, m, 1)))


def natural_label(shape_id: Column) -> Column:
    """type_color as "color type"; other ids with spaces for underscores."""
    parts = F.split(shape_id, "_")
    return F.when(F.size(parts) == 2, F.concat(F.get(parts, 1), F.lit(" "), F.get(parts, 0))).otherwise(F.replace(shape_id, F.lit("_"), F.lit(" ")))


def movement(path: Column) -> Column:
    """The movement along a path of quadrants (array of numbers): within, from-to, or from-to-through."""
    names = F.transform(path, lambda q: F.concat(_named(q, QUADRANTS), F.lit(" quadrant")))
    n = F.size(path)
    ends = F.concat(F.lit("from "), F.get(names, 0), F.lit(" to "), F.get(names, n - 1))
    through = english_list(F.slice(names, F.lit(2), F.greatest(n - 2, F.lit(0))))
    return F.when(n == 0, F.lit("within top left quadrant")).when(n == 1, F.concat(F.lit("within "), F.get(names, 0))).when(n == 2, ends).otherwise(F.concat(ends, F.lit(" through "), through))


def event_names(peers: Column) -> Column:
    return english_list(F.transform(F.array_sort(peers), lambda i: F.concat(F.lit("Event "), F.lpad(i.cast("string"), 4, "0"))))


def event_sentence(index: Column, shape_id: Column, path: Column, peers: Column, peers_first: bool = False, relative: Column | bool = False) -> Column:
    """One event: what moved where, and with which events at the same time, told at the end or at the start."""
    relative = F.lit(relative) if isinstance(relative, bool) else relative
    moved = F.concat(shape_label(shape_id), F.lit(" moved "), movement(path), F.when(relative, F.lit(" relative to the scene center")).otherwise(F.lit("")))
    head = F.concat(F.lit("Event "), F.lpad(index.cast("string"), 4, "0"), F.lit(": "))
    if peers_first:
        return F.when(F.size(peers) > 0, F.concat(head, F.lit("At the same time as "), event_names(peers), F.lit(", "), moved, F.lit("."))).otherwise(F.concat(head, moved, F.lit(".")))
    return F.when(F.size(peers) > 0, F.concat(head, moved, F.lit(". This happened at the same time as "), event_names(peers), F.lit("."))).otherwise(F.concat(head, moved, F.lit(".")))


def pair_sentence(pair: Column, event: Column, a: Column, b: Column, horizontal: Column, vertical: Column, vertical_first: bool = False) -> Column:
    """How one shape stands to another after an event; the relations are given by number."""
    h, v = _named(horizontal, HORIZONTAL), _named(vertical, VERTICAL)
    first, second = (v, h) if vertical_first else (h, v)
    return F.concat(F.lit("Pair "), F.lpad(pair.cast("string"), 4, "0"), F.lit(": [event "), F.lpad(event.cast("string"), 4, "0"), F.lit("] "), a, F.lit(" is "), first, F.lit(" "), b, F.lit(" and is "), second, F.lit(" "), b, F.lit("."))


def horizontal_relation(ax: Column, bx: Column) -> Column:
    return F.when(ax < bx, 0).when(ax > bx, 1).otherwise(2)


def vertical_relation(ay: Column, by: Column) -> Column:
    return F.when(ay > by, 0).when(ay < by, 1).otherwise(2)


def header(scene_id: Column, events: Column) -> Column:
    return F.concat(F.lit("Scene "), scene_id, F.lit(": "), events.cast("string"), F.lit(" motion events."))


def read_event(line: Column, index: str = r"\d+") -> dict[str, Column]:
    """The parts of an event sentence in either order: index (of the given form), shape_id, start and end quadrant, peers. Nulls for lines of another form."""
    late = rf"^Event ({index}): (.+? shape) moved (.+?)( relative to the scene center)?\.(?: This happened at the same time as (.+)\.)?$"
    early = rf"^Event ({index}): At the same time as (.*Event \d+), (.+? shape) moved (.+?)( relative to the scene center)?\.$"
    is_early = line.rlike(early)
    part = lambda a, b: F.when(is_early, F.regexp_extract(line, early, a)).when(line.rlike(late), F.regexp_extract(line, late, b))
    moved = part(4, 3)
    quadrant = lambda text: (F.array_position(F.array(*map(F.lit, QUADRANTS)), text) - 1).cast("int")
    within, between = r"^within (.+) quadrant$", r"^from (.+?) quadrant to (.+?) quadrant"
    start = F.when(moved.rlike(within), F.regexp_extract(moved, within, 1)).otherwise(F.regexp_extract(moved, between, 1))
    end = F.when(moved.rlike(within), F.regexp_extract(moved, within, 1)).otherwise(F.regexp_extract(moved, between, 2))
    peers = F.transform(F.regexp_extract_all(F.coalesce(part(2, 5), F.lit("")), F.lit(r"Event (\d+)"), F.lit(1)), lambda x: x.cast("bigint"))
    return {"event_index": part(1, 1).cast("bigint"), "shape_id": read_shape_label(part(3, 2)), "start_quadrant": quadrant(start), "end_quadrant": quadrant(end), "peers": peers}


def read_pair(line: Column) -> dict[str, Column]:
    """The parts of a pair sentence in either order of its relations; nulls for lines of another form."""
    form = r"^Pair (\d+): \[event (\d+)\] (\S+) is (.+) (\S+) and is (.+) (\S+)\.$"
    g = lambda i: F.when(line.rlike(form), F.regexp_extract(line, form, i))

    def known(text: Column, table: dict[str, int]) -> Column:
        out = F.lit(None).cast("int")
        for phrase, i in table.items():
            out = F.when(text == phrase, F.lit(i)).otherwise(out)
        return out

    either = lambda table: F.coalesce(known(g(4), table), known(g(6), table))
    return {"pair_index": g(1).cast("bigint"), "event_index": g(2).cast("bigint"), "first": g(3), "second": g(5), "horizontal": either(HORIZONTAL_READ), "vertical": either(VERTICAL_READ)}


def round_away(v: Column) -> Column:
    """Three decimals, rounded away from zero whatever follows; a negative zero becomes zero."""
    scaled = v * 1000.0
    return F.when(v >= 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("double") / 1000.0


def match_case(template: Column, word: Column) -> Column:
    """word in the case of template: all capitals, a capital first, or small. One capital letter counts as all capitals."""
    return F.when(template.rlike("^[A-Z]+$"), F.upper(word)).when(template.rlike("^[A-Z]"), F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))).otherwise(F.lower(word))


def letters(text: Column) -> Column:
    """The words of a text: maximal runs of ASCII letters."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))


def unsynonym(word: Column) -> Column:
    """The word that a synonym stands for, in the synonym's case; other words as they are. The first head word in the alphabet wins."""
    out = word
    for head in sorted(SYNONYMS, reverse=True):
        out = F.when(F.lower(word).isin(*SYNONYMS[head]), match_case(word, F.lit(head))).otherwise(out)
    return out


def typo_variants(word: str) -> set[str]:
    """All that one typing error can make of a word: a letter doubled, left out, replaced by or joined by a neighbour on the keyboard, or two swapped."""
    near = keyboard_neighbours()
    made = {word[: i + 1] + word[i:] for i in range(len(word))}
    if len(word) >= 2:
        made |= {word[:i] + word[i + 1 :] for i in range(len(word))}
        made |= {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    for i, c in enumerate(word):
        for n in near.get(c.lower(), ""):
            n = n.upper() if c.isupper() else n
            made |= {word[:i] + n + word[i + 1 :], word[: i + 1] + n + word[i + 1 :], word[:i] + n + word[i:]}
    return made - {word}


@lru_cache(maxsize=1)
def _fixes() -> dict[str, str]:
    """Every misspelling that exactly one word of the vocabulary explains, with that word."""
    of: dict[str, set[str]] = {}
    for word in VOCABULARY:
        for v in typo_variants(word):
            of.setdefault(v, set()).add(word)
    return {v: next(iter(w)) for v, w in sorted(of.items()) if len(w) == 1 and v not in VOCABULARY}


def corrections(spark: SparkSession) -> DataFrame:
    """(observed, word): every misspelling that exactly one word of the vocabulary explains. Its size depends on the vocabulary only."""
    return spark.createDataFrame([*_fixes().items()], "observed string, word string")


def corrected_words(words: DataFrame, word: str, out: str = "corrected") -> DataFrame:
    """words with each misspelling put right and each synonym undone."""
    table = corrections(words.sparkSession).withColumnRenamed("word", "_word")
    fixed = words.join(F.broadcast(table), F.col(word) == F.col("observed"), "left").drop("observed")
    plain = F.coalesce("_word", word)
    return fixed.withColumn(out, F.when(plain == "translated", F.lit("moved")).otherwise(unsynonym(plain))).drop("_word")


def _never(rate: float) -> bool:
    return not math.isfinite(rate) or rate <= 0


def synonym_candidate(raw: Column) -> Column:
    """A word as the thesaurus may hold it: trimmed and small; null for anything but ASCII letters."""
    word = F.lower(F.trim(raw))
    return F.when(word.rlike("^[a-z]+$"), word)


def normalised(spark: SparkSession, lines: DataFrame, line: str = "line", out: str = "normal") -> DataFrame:
    """lines with their words put right: typing errors first, then synonyms; `translated` is `moved`. What is not a word stays.

    The table of corrections, whose size depends on the vocabulary only, is one broadcast row. It is searched for words only that are
    neither of the vocabulary nor of the thesaurus, as a search takes time in proportion to its size.
    """
    plain_words = sorted({*VOCABULARY, *SYNONYMS, *(v for others in SYNONYMS.values() for v in others)} - _fixes().keys())
    known = sorted({f(w) for w in plain_words for f in (str, str.capitalize)} - _fixes().keys())
    entries = F.map_from_entries(F.collect_list(F.struct("observed", "word"))).alias("_fixes")
    fixes = corrections(spark).agg(entries)
    pieces = F.regexp_extract_all(F.col(line), F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))

    def one(piece: Column) -> Column:
        searched = F.coalesce(F.try_element_at(F.col("_fixes"), piece), piece)
        plain = F.when(~piece.rlike("^[A-Za-z]") | piece.isin(known), piece).otherwise(searched)
        return F.when(plain == "translated", F.lit("moved")).otherwise(unsynonym(plain))

    return lines.crossJoin(F.broadcast(fixes)).withColumn(out, F.array_join(F.transform(pieces, one), "")).drop("_fixes")


def read_header(line: Column) -> dict[str, Column]:
    """The scene's id and its number of events; nulls for lines of another form."""
    form = r"^Scene ([0-9a-f]{32}): (\d+) motion events\.$"
    g = lambda i: F.when(line.rlike(form), F.regexp_extract(line, form, i))
    return {"scene_id": g(1), "events": g(2).cast("bigint")}


def decoded(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(scene_index, kind, place, what): the meaning of each scene's lines (scene_index, line), whatever their order and surface.

    kind is header, event or pair; place its index; what a struct of all that was read, with nulls for what its kind lacks. Lines that can't be read have kind `unread`.
    """
    rows = normalised(spark, lines)
    normal = F.col("normal")
    # A scene's id may look like a misspelt word.
    event, pair, head = read_event(normal), read_pair(normal), read_header(F.col("line"))
    kind = F.when(head["events"].isNotNull(), "header").when(event["shape_id"].isNotNull() & event["end_quadrant"].isNotNull(), "event").when(pair["horizontal"].isNotNull() & pair["vertical"].isNotNull(), "pair").otherwise("unread")
    rows = rows.withColumn("kind", kind)
    is_ = lambda k, c: F.when(F.col("kind") == k, c)
    what = F.struct(
        head["scene_id"].alias("scene_id"), head["events"].alias("events"), is_("event", event["shape_id"]).alias("shape_id"), is_("event", event["start_quadrant"]).alias("start_quadrant"),
        is_("event", event["end_quadrant"]).alias("end_quadrant"), is_("event", F.array_sort(event["peers"])).alias("peers"), is_("pair", pair["event_index"]).alias("event_index"),
        is_("pair", pair["first"]).alias("first"), is_("pair", pair["second"]).alias("second"), is_("pair", pair["horizontal"]).alias("horizontal"), is_("pair", pair["vertical"]).alias("vertical"),
    )
    place = F.when(F.col("kind") == "event", event["event_index"]).when(F.col("kind") == "pair", pair["pair_index"]).otherwise(F.lit(0).cast("bigint"))
    return rows.select("scene_index", "kind", place.alias("place"), what.alias("what"))


def text_faults(meaning: DataFrame) -> DataFrame:
    """(scene_index, fault): scenes whose decoded lines don't make a text: lines that can't be read, not one header, gaps or repeats among events or pairs, another number of events than the header says."""
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    counted = meaning.groupBy("scene_index").agg(
        F.count_if(F.col("kind") == "unread").alias("unread"), F.count_if(F.col("kind") == "header").alias("headers"), F.max("what.events").alias("said"),
        *(f(of(kind, F.col("place"))).alias(f"{kind}_{name}") for kind in ("event", "pair") for name, f in (("n", F.count), ("distinct", F.countDistinct), ("last", F.max), ("first", F.min))),
    )
    gap = lambda kind: (F.col(f"{kind}_n") > 0) & ((F.col(f"{kind}_first") != 0) | (F.col(f"{kind}_last") != F.col(f"{kind}_n") - 1) | (F.col(f"{kind}_distinct") != F.col(f"{kind}_n")))
    rules = F.array(
        F.when(F.col("unread") > 0, "unread"), F.when(F.col("headers") != 1, "header"), F.when(gap("event"), "event index"), F.when(gap("pair"), "pair index"),
        F.when(F.col("said") != F.col("event_n"), "event count"),
    )
    return counted.select("scene_index", F.explode(F.array_compact(rules)).alias("fault"))


def vary(line: Column, rate: float, seed: Column) -> Column:
    """line with some of its words replaced by synonyms: each that has one, with the given probability, by a hash of seed and place."""
    if _never(rate):
        return line
    pieces = F.regexp_extract_all(line, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))

    def one(piece: Column, i: Column) -> Column:
        draw = F.pmod(F.xxhash64(seed, i), F.lit(1_000_003)) / F.lit(1_000_003.0)
        choice = F.lit(None).cast("string")
        for head, others in SYNONYMS.items():
            pick = F.get(F.array(*map(F.lit, others)), F.pmod(F.xxhash64(seed, i, F.lit(1)), F.lit(len(others))).cast("int"))
            choice = F.when(F.lower(piece) == head, match_case(piece, pick)).otherwise(choice)
        return F.when((draw < rate) & choice.isNotNull(), choice).otherwise(piece)

    return F.array_join(F.transform(pieces, one), "")


def trimmed(text: Column, with_pairs: bool) -> Column:
    """A scene's text for display: without its header; up to the first pair sentence unless pairs are wanted."""
    rows = F.split(text, "\n")
    body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    if not with_pairs:
        first = F.array_position(F.transform(body, lambda x: x.startswith("Pair ")), F.lit(True))
        body = F.when(first > 0, F.slice(body, F.lit(1), (first - 1).cast("int"))).otherwise(body)
    return F.array_join(body, "\n")


def read_sequence(raw: Column) -> Column:
    """A comma-separated list of numbers from 1 to 4, blanks passed over; null if anything else stands in it or nothing does."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda t: F.trim(t)), lambda t: t != "")
    fine = (F.size(parts) > 0) & F.forall(parts, lambda t: t.rlike(r"^\+?0*[1-4]$"))
    return F.when(fine, F.transform(parts, lambda t: t.cast("int")))


def read_integer(raw: Column) -> Column:
    return F.trim(raw).try_cast("bigint")


def read_quadrant(raw: Column) -> Column:
    s = read_sequence(raw)
    return F.when(F.size(s) == 1, F.get(s, 0))


def read_shape(raw: Column) -> Column:
    """The shape that an answer names: type and colour in either order, run together or in free text; null if one is missing."""
    flat = F.regexp_replace(F.lower(raw), "[^a-z0-9]", "")
    tight = F.lit(None).cast("string")
    for s in SHAPES:
        for c in COLOURS:
            tight = F.when(flat.isin(s + c, c + s), F.lit(f"{s}_{c}")).otherwise(tight)
    tokens = F.filter(F.split(F.regexp_replace(F.lower(raw), "[^a-z]", " "), " "), lambda t: t != "")
    first = lambda names: F.get(F.filter(tokens, lambda t: t.isin(*names)), 0)
    return F.coalesce(tight, F.concat(first(SHAPES), F.lit("_"), first(COLOURS)))


def graded(kind: Column, expected: Column, raw: Column) -> Column:
    """Whether an answer is right, read by the kind of its question (sequence, integer, quadrant, shape); what can't be read is wrong."""
    right = F.when(kind == "sequence", F.array_join(read_sequence(raw), ",") == expected).when(kind == "integer", read_integer(raw).cast("string") == expected)
    right = right.when(kind == "quadrant", read_quadrant(raw).cast("string") == expected).when(kind == "shape", read_shape(raw) == expected)
    return F.coalesce(right, F.lit(False))


def protected(word: Column) -> Column:
    """Words that never get a typing error: those that the grammar or the thesaurus needs."""
    return F.lower(word).isin("scene", "event", "pair", *SYNONYMS, *(v for others in SYNONYMS.values() for v in others))


def mistype(line: Column, rate: float, seed: Column) -> Column:
    """line with typing errors: each word of four letters or more that is not protected gets one with the given probability, by a hash of seed and place.

    The error is a letter doubled, left out, or swapped with the next, or a neighbour on the keyboard in a letter's place or beside it.
    """
    if _never(rate):
        return line
    near = F.create_map(*(F.lit(x) for item in keyboard_neighbours().items() for x in item))
    pieces = F.regexp_extract_all(line, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))

    def one(piece: Column, i: Column) -> Column:
        draw = lambda tag, n: F.pmod(F.xxhash64(seed, i, F.lit(tag)), n).cast("int")
        n = F.length(piece)
        at = draw(10, n) + 1
        letter = F.substring(piece, at, F.lit(1))
        keys = F.coalesce(F.element_at(near, F.lower(letter)), letter)
        key = F.substring(keys, draw(11, F.length(keys)) + 1, F.lit(1))
        head, tail = F.substring(piece, F.lit(1), at - 1), F.substring(piece, at + 1, n)
        swapped = F.concat(head, F.substring(tail, F.lit(1), F.lit(1)), letter, F.substring(tail, F.lit(2), n))
        kind = draw(12, F.lit(6))
        wrong = F.when(kind == 0, F.concat(head, letter, letter, tail)).when(kind == 1, F.concat(head, tail)).when(kind == 2, swapped)
        wrong = wrong.when(kind == 3, F.concat(head, key, tail)).when(kind == 4, F.concat(head, letter, key, tail)).otherwise(F.concat(head, key, letter, tail))
        hit = piece.rlike("^[A-Za-z]{4,}$") & ~protected(piece) & (draw(13, F.lit(1_000_003)) / F.lit(1_000_003.0) < rate)
        return F.when(hit, wrong).otherwise(piece)

    return F.array_join(F.transform(pieces, one), "")
