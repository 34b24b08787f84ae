"""Chat formatting: the turns of raw transcripts, recovered by a hidden Markov model over their lines.

A line's hidden state is the role that speaks in it and whether it opens a turn. What is seen of a line: the speaker its marker names, if any;
whether the line before was empty; and its style (asks, greets or instructs; its length). Viterbi's algorithm finds
the likeliest roles of all lines with a character; lines of one turn, empty ones between them included, are then joined and rendered in one canonical form.

A transcript is one text, however many rows it comes in: a row ends where a line ends, and nothing else is told by it. Transcripts of
ordinary size are gathered and solved many at a time, step by step for all of them together. A transcript beyond `Settings.long_rows` or
`long_chars` is never gathered: its lines are put in order by a range sort, which cuts it into many partitions, and worked on in segments. The
best paths through a segment, from any state to any, form a small matrix; matrices multiply (max-plus) in order to give each segment the
states it starts from and ends in; then each segment is traced on its own. Both ways give the same turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

ROLES = ("system", "user", "assistant", "tool")
#: What speakers are called in transcripts.
NAMES = {
    "system": "system|sys|instructions?|context",
    "user": "user|human|customer|client|question|q|me|prompter|you",
    "assistant": "assistant|ai|bot|chatbot|agent|answer|a|gpt|model|response",
    "tool": "tool|function|observation",
}
_ANY_NAME = "|".join(NAMES.values())
#: A marker: the name alone in brackets or tags, or before a colon, at the start of a line.
MARKER = re.compile(
    rf"\s*(?:#{{1,6}}\s*|>\s*|\*{{1,2}}|\[|<\|?(?:im_start\|>)?\s*|\(|-\s*)*({_ANY_NAME})\s*(?:\|?>|\]|\)|\*{{1,2}})?\s*(?::\s*\*{{0,2}}|\|>|\]|(?<=[>\])])|$)\s*", re.I
)
_ROLE_OF = [(re.compile(names, re.I), 1 + i) for i, names in enumerate(NAMES.values())]
_ASKS = re.compile(r"\s*(?:please|can you|could you|how|what|why|when|where|who)\b", re.I)
_LINE_END = re.compile(r"\r\n|\n|\r")
#: White space that is taken off both ends of a turn.
ENDS = " \t\n\x0b\x0c\r"
#: States: for each role, a line that opens a turn, and one that goes on.
STATES = 2 * len(ROLES)
#: Codes of what is seen: marker (none or a role) x line before empty x asks x length class.
LENGTHS = (20, 40, 80, 160, 320, 640)
PER_MARKER = 2 * 2 * (len(LENGTHS) + 1)
CODES = (1 + len(ROLES)) * PER_MARKER
AFTER_EMPTY = 2 * (len(LENGTHS) + 1)


@dataclass(frozen=True)
class Settings:
    """fit_transcripts bounds the labelled transcripts that the model is counted from, those of the least hash of their id among those that are not long.

    long_rows and long_chars bound what is gathered of one transcript, segment_bits the lines of a segment of a longer one.
    """

    fit_transcripts: int = 1000
    smoothing: float = 0.5
    long_rows: int = 1024
    long_chars: int = 1 << 20
    segment_bits: int = 14
    #: Characters of transcripts that are solved together.
    batch_chars: int = 1 << 22
    #: Ids of long transcripts that are broadcast at most; beyond, they are joined by a shuffle.
    broadcast_ids: int = 100_000


@dataclass
class Model:
    """Log probabilities: of the first state, of the next state, and of what is seen in a state."""

    start: np.ndarray
    step: np.ndarray
    seen: np.ndarray


def code(line: str) -> int:
    """What is seen of a line that doesn't follow an empty one, as one number; AFTER_EMPTY is added where it does."""
    marker = 0
    m = MARKER.match(line)
    if m:
        marker = next(i for names, i in _ROLE_OF if names.fullmatch(m[1]))
    n = len(line)
    asks = line.rstrip().endswith("?") or _ASKS.match(line) is not None
    return marker * PER_MARKER + asks * (len(LENGTHS) + 1) + sum(n >= x for x in LENGTHS)


def observed(lines: list[str], after_empty: bool = True) -> tuple[list[int], list[int]]:
    """(places, codes) of the lines with a character; after_empty tells of the line before the first, and is true at the start of a transcript."""
    places, codes = [], []
    for i, line in enumerate(lines):
        if not line.strip():
            after_empty = True
            continue
        places.append(i)
        codes.append(code(line) + AFTER_EMPTY * after_empty)
        after_empty = False
    return places, codes


def _pieces(df: DataFrame, id_col: str, order_col: str, text_col: str, *more: str) -> DataFrame:
    """The rows of transcripts: conv, ord, tie, text, and more. Rows are taken by ord, nulls first, then by a hash of the text and the text. Null texts have no lines."""
    text = F.col(text_col).cast("string")
    return df.where(text.isNotNull()).select(F.col(id_col).alias("conv"), F.col(order_col).alias("ord"), F.xxhash64(text).alias("tie"), text.alias("text"), *more)


def _split(pieces: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary transcripts, and those of long ones, if there are any. Null ids form one transcript."""
    sizes = pieces.groupBy("conv").agg(F.count("*").alias("rows"), F.sum(F.length("text") + 1).alias("chars"))
    long_ids = cut(sizes.where((F.col("rows") > settings.long_rows) | (F.col("chars") > settings.long_chars)).select(F.col("conv").alias("_conv")))
    many = long_ids.count()
    if not many:
        return pieces, None
    ids = F.broadcast(long_ids) if many <= settings.broadcast_ids else long_ids
    same = F.col("conv").eqNullSafe(F.col("_conv"))
    return pieces.join(ids, same, "left_anti"), pieces.join(ids, same, "left_semi")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, rows) of each transcript, whose rows come one after another; rows are tuples of the columns from the second on."""
    held, last, begun = [], None, False
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for key, *row in zip(*columns):
            if begun and key != last:
                yield last, held
                held = []
            last, begun = key, True
            held.append(row)
    if begun:
        yield last, held


def fit(transcripts: DataFrame, role_col: str, settings: Settings = Settings(), id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> Model:
    """Count a model from transcripts whose rows are turns of known roles (`function` counts as tool). The first line with a character of a row opens its turn.

    Rows of other or no roles count as lines, but nothing is learnt of them nor of the step after them. Without rows to learn from, the model knows only what markers say.
    """
    role = F.lower(F.col(role_col))
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.when(role == "function", "tool").otherwise(role)).cast("int") - 1
    pieces = _pieces(transcripts.where(F.col(id_col).isNotNull()).withColumn("_role", role), id_col, order_col, text_col, "_role")
    ordinary, _ = _split(pieces, settings)
    ids = ordinary.select("conv").distinct().orderBy(F.xxhash64("conv"), "conv").limit(settings.fit_transcripts)
    chosen = ordinary.join(F.broadcast(ids), "conv", "left_semi")

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], int] = {}
        for _, rows in _gathered(batches):
            before, after_empty = -1, True
            for role, text in rows:
                opens = True
                for line in _LINE_END.split(text):
                    if not line.strip():
                        after_empty = True
                        continue
                    state = -2 if role is None or role < 0 else 2 * role + (not opens)
                    seen = code(line) + AFTER_EMPTY * after_empty
                    if state >= 0:
                        for key in ((0, before, state), (1, state, seen)):
                            counts[key] = counts.get(key, 0) + 1
                    before, after_empty, opens = state, False, False
        yield pa.RecordBatch.from_pylist([{"kind": k, "a": a, "b": b, "n": n} for (k, a, b), n in counts.items()], schema=pa.schema([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))

    dealt = chosen.repartition("conv").sortWithinPartitions("conv", "ord", "tie", "text").select("conv", "_role", "text")
    found = dealt.mapInArrow(work, "kind int, a int, b int, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    start, step, seen = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CODES))
    for r in found:
        if r["kind"] == 1:
            seen[r["a"], r["b"]] += r["n"]
        elif r["a"] == -1:
            start[r["b"]] += r["n"]
        elif r["a"] >= 0:
            step[r["a"], r["b"]] += r["n"]
    # A turn goes on in its own role, and a transcript starts with a line that opens a turn: all else can't be.
    may = np.array([[(b % 2 == 0) or (a // 2 == b // 2) for b in range(STATES)] for a in range(STATES)])
    first = np.array([s % 2 == 0 for s in range(STATES)])
    # A marker tells more than any count: what a role's own marker is seen with is shared over all markers evenly.
    markers = np.arange(CODES) // PER_MARKER
    prior = np.full((STATES, CODES), settings.smoothing)
    for s in range(STATES):
        opens = s % 2 == 0
        prior[s, markers == 1 + s // 2] *= 40 if opens else 0.002
        prior[s, (markers > 0) & (markers != 1 + s // 2)] *= 0.002
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    with np.errstate(divide="ignore"):
        return Model(log((start + settings.smoothing) * first), log((step + settings.smoothing) * may), log(seen + prior))


def solved(model: Model, sequences: list[list[int]]) -> list[np.ndarray]:
    """The likeliest states of each sequence of codes; all sequences take their next step together. Among equals the least state wins."""
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: -len(sequences[i]))
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(sequences)
    if not order:
        return out
    sizes = np.array([len(sequences[i]) for i in order])
    grid = np.zeros((len(order), int(sizes[0])), np.int32)
    for row, i in enumerate(order):
        grid[row, : sizes[row]] = sequences[i]
    # Sequences come longest first, so those that still go on are the first ones.
    going = np.searchsorted(-sizes, -np.arange(grid.shape[1]), "left")
    score = model.start + model.seen.T[grid[:, 0]]
    back = [np.zeros((0, STATES), np.int8)]
    for t in range(1, grid.shape[1]):
        n = going[t]
        ways = score[:n, :, None] + model.step
        back.append(ways.argmax(axis=1).astype(np.int8))
        score[:n] = ways.max(axis=1) + model.seen.T[grid[:n, t]]
    states = np.empty(grid.shape, np.int8)
    states[np.arange(len(order)), sizes - 1] = score.argmax(axis=1)
    for t in range(grid.shape[1] - 1, 0, -1):
        n = np.arange(going[t])
        states[n, t - 1] = back[t][n, states[n, t]]
    for row, i in enumerate(order):
        out[i] = states[row, : sizes[row]]
    return out


def viterbi(model: Model, codes: list[int] | np.ndarray) -> np.ndarray:
    """The likeliest states of one sequence."""
    return solved(model, [codes])[0]


def body(line: str) -> str:
    """A line that opens a turn, without its marker."""
    m = MARKER.match(line)
    return line[m.end() :] if m else line


def _turns(lines: list[str], places: list[int], states: np.ndarray) -> list[tuple[int, str]]:
    """(role, text) of each turn of a whole transcript."""
    opens = [p for p, s in zip(places, states.tolist()) if s % 2 == 0]
    roles = [s // 2 for s in states.tolist() if s % 2 == 0]
    ends = [*opens[1:], len(lines)]
    return [(r, "\n".join([body(lines[a]), *lines[a + 1 : b]]).strip(ENDS)) for r, a, b in zip(roles, opens, ends)]


def turns(df: DataFrame, model: Model, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The turns of raw transcripts: conv_id, turn_no (from 0), role, text (markers and outer white space taken off, lines joined by line ends), rendered (the canonical form of the turn).

    The rows of one id, by order_col, are one transcript, joined by line ends. Rows without an id form one transcript as well. Null texts have no
    lines; a transcript without a character has no turns. Where a turn holds `<|`, its rendering has a backslash more in it, so that no text reads as a marker.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    ordinary, long_ones = _split(_pieces(df, id_col, order_col, text_col), settings)
    conv_type = ordinary.schema["conv"].dataType.simpleString()
    schema = f"conv {conv_type}, turn_no bigint, role int, text string"
    arrow_type = pa.schema([("turn_no", pa.int64()), ("role", pa.int32()), ("text", pa.string())])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_type, held, size = None, [], 0

        def peeked():
            nonlocal ids_type
            for batch in batches:
                ids_type = batch.schema.field(0).type
                yield batch

        def results():
            seen = [observed(lines) for _, lines in held]
            ids, out = [], []
            for (conv, lines), (places, _), states in zip(held, seen, solved(shared.value, [codes for _, codes in seen])):
                for number, (role, text) in enumerate(_turns(lines, places, states)):
                    ids.append(conv)
                    out.append((number, role, text))
            columns = [pa.array([x[j] for x in out], f.type) for j, f in enumerate(arrow_type)]
            return pa.RecordBatch.from_arrays([pa.array(ids, ids_type), *columns], names=["conv", *arrow_type.names])

        for conv, rows in _gathered(peeked()):
            held.append((conv, [line for (text,) in rows for line in _LINE_END.split(text)]))
            size += sum(len(text) for (text,) in rows)
            if size >= settings.batch_chars or len(held) >= 4096:
                yield results()
                held, size = [], 0
        if held:
            yield results()

    dealt = ordinary.repartition("conv").sortWithinPartitions("conv", "ord", "tie", "text").select("conv", "text")
    said = dealt.mapInArrow(work, schema)
    if long_ones is not None:
        said = said.unionByName(_long_turns(long_ones, shared, settings, conv_type))
    role = F.get(F.array(*map(F.lit, ROLES)), F.col("role"))
    shown = F.regexp_replace("text", r"<(\\*)\|", r"<\\$1|")
    rendered = F.concat(F.lit("<|"), role, F.lit("|>\n"), shown, F.lit("\n<|end|>\n"))
    return said.select(F.col("conv").alias("conv_id"), "turn_no", role.alias("role"), "text", rendered.alias("rendered"))


def _matrix(model: Model, codes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For a segment: the best log probability of its lines after the first, from each state of the first line to each of the last, and how many turns open on that way."""
    best = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
    opens = np.zeros((STATES, STATES), np.int64)
    new = (np.arange(STATES) % 2 == 0).astype(np.int64)
    for c in codes[1:]:
        ways = best[:, :, None] + model.step
        at = ways.argmax(axis=1)
        best = ways.max(axis=1) + model.seen[:, c]
        opens = np.take_along_axis(opens, at, axis=1) + new
    return best, opens


def _traced(model: Model, codes: list[int], first: int, last: int) -> np.ndarray:
    """The best states of a segment's lines, given the states of its first and last line."""
    score = np.where(np.arange(STATES) == first, 0.0, -np.inf)
    back = np.zeros((len(codes), STATES), np.int8)
    for i, c in enumerate(codes[1:], 1):
        ways = score[:, None] + model.step
        back[i] = ways.argmax(axis=0)
        score = ways.max(axis=0) + model.seen[:, c]
    out = np.empty(len(codes), np.int8)
    out[-1] = last
    for i in range(len(codes) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _long_turns(pieces: DataFrame, shared, settings: Settings, conv_type: str) -> DataFrame:
    """(conv, turn_no, role, text) of transcripts that are too long to be gathered."""
    keys = ["conv", "ord", "tie"]
    dealt = pieces.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select("conv", F.spark_partition_id().cast("bigint").alias("part"), "text")

    @tidy
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, of, one = 0, [], 0, None, None

        def out() -> pa.RecordBatch:
            places, codes = observed(held, after_empty=False)
            best, opens = _matrix(shared.value, codes)
            # What precedes the segment matters only if its very first line has a character.
            first, open_ended = (codes[0], places[0] == 0) if codes else (-1, False)
            values = [pa.array([of[1] << 33 | number]), pa.array([held], pa.list_(pa.string())), pa.array([first], pa.int32()), pa.array([open_ended]), pa.array([not held[-1].strip()])]
            return pa.RecordBatch.from_arrays([one, *values, pa.array([best.ravel().tolist()]), pa.array([opens.ravel().tolist()])], names=_SEGMENT)

        for batch in batches:
            for i, (conv, part, text) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)))):
                if held and (conv, part) != of:
                    yield out()
                    number, held, size = number + 1, [], 0
                of, one = (conv, part), batch.column(0).slice(i, 1)
                for line in _LINE_END.split(text):
                    held.append(line)
                    size += len(line)
                    if len(held) >= 1 << settings.segment_bits or size >= settings.long_chars:
                        yield out()
                        number, held, size = number + 1, [], 0
        if held:
            yield out()

    schema = f"conv {conv_type}, segment bigint, lines array<string>, first int, open_ended boolean, ends_empty boolean, best array<double>, opens array<bigint>"
    rows = cut(dealt.mapInArrow(segments, schema))

    @tidy
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict = {}

        def peeked():
            for batch in batches:
                ids["type"] = batch.schema.field(0).type
                yield batch

        for conv, got in _gathered(peeked()):
            segment, *rest = zip(*got)
            states, codes, before = _joined(shared.value, *rest)
            values = [pa.array(segment, pa.int64()), *(pa.array([s[j] for s in states], pa.int32()) for j in (0, 1)), pa.array(codes, pa.int32()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(segment), ids["type"]), *values], names=["_conv", "_segment", "first_state", "last_state", "first_code", "before"])

    known = rows.select("conv", "segment", "first", "open_ended", "ends_empty", "best", "opens").repartition("conv").sortWithinPartitions("conv", "segment")
    states = known.mapInArrow(ends, f"_conv {conv_type}, _segment bigint, first_state int, last_state int, first_code int, before bigint")

    @tidy
    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment, lines, first, last, first_code, before = (batch.column(j)[i].as_py() for j in range(1, 7))
                pieces = _traced_turns(shared.value, lines, first, last, first_code, before)
                columns = [pa.array([x[0] for x in pieces], pa.int64()), pa.array([segment] * len(pieces), pa.int64()), pa.array([x[1] for x in pieces], pa.int32()), pa.array(["\n".join(x[2]) for x in pieces], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(pieces), pa.int64())), *columns], names=["conv", "turn_no", "segment", "role", "text"])

    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment"))
    joined = rows.select("conv", "segment", "lines").join(states, same).select("conv", "segment", "lines", "first_state", "last_state", "first_code", "before")
    found = joined.mapInArrow(traced, f"conv {conv_type}, turn_no bigint, segment bigint, role int, text string")
    parts = F.array_sort(F.collect_list(F.struct("segment", "text")))
    whole = F.array_join(F.transform(parts, lambda x: x["text"]), "\n")
    out = found.groupBy("conv", "turn_no").agg(F.max("role").alias("role"), whole.alias("text"))
    return out.withColumn("text", F.regexp_replace("text", r"\A[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z", ""))


_SEGMENT = ["conv", "segment", "lines", "first", "open_ended", "ends_empty", "best", "opens"]


def _joined(m: Model, first, open_ended, ends_empty, best, opens) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """For the segments of a transcript in order: the states of their first and last lines with a character (-1 if they have none), the code of the first, and how many turns opened before."""
    mats, opens = (np.array(x).reshape(-1, STATES, STATES) for x in (best, opens))
    codes = [f + AFTER_EMPTY * (o and e) for f, o, e in zip(first, open_ended, [True, *ends_empty[:-1]])]
    told = [i for i, f in enumerate(first) if f >= 0]
    into: list[np.ndarray] = []
    for n, i in enumerate(told):
        if not n:
            into.append(m.start + m.seen[:, codes[i]])
        else:
            out = (into[-1][:, None] + mats[told[n - 1]]).max(axis=0)
            into.append((out[:, None] + m.step).max(axis=0) + m.seen[:, codes[i]])
    states = [(-1, -1)] * len(first)
    last = int((into[-1][:, None] + mats[told[-1]]).max(axis=0).argmax()) if told else -1
    for n in range(len(told) - 1, -1, -1):
        i = told[n]
        start = int((into[n] + mats[i][:, last]).argmax())
        states[i] = start, last
        if n:
            out = (into[n - 1][:, None] + mats[told[n - 1]]).max(axis=0)
            last = int((out + m.step[:, start]).argmax())
    before, total = [], 0
    for i, (a, z) in enumerate(states):
        before.append(total)
        total += 0 if a < 0 else int(opens[i][a, z]) + (a % 2 == 0)
    return states, codes, before


def _traced_turns(m: Model, lines: list[str], first: int, last: int, first_code: int, before: int) -> list[tuple[int, int | None, list[str]]]:
    """(turn, role, lines) of a segment; the role is null for lines that go on with the turn of the segment before. Empty lines before the first turn are dropped."""
    places, codes = observed(lines, after_empty=False)
    opening = []
    if codes:
        codes[0] = first_code
        opening = [(p, s // 2) for p, s in zip(places, _traced(m, codes, first, last).tolist()) if s % 2 == 0]
    out: list[tuple[int, int | None, list[str]]] = []
    head = opening[0][0] if opening else len(lines)
    if head and before:
        out.append((before - 1, None, lines[:head]))
    for number, ((p, role), to) in enumerate(zip(opening, [*(p for p, _ in opening[1:]), len(lines)])):
        out.append((before + number, role, [body(lines[p]), *lines[p + 1 : to]]))
    return out
