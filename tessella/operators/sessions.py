"""Session state as folds over an event log: guarded cursors, markers, latest rows, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cursor_fold(log: DataFrame, key: str, order: list[str], expected: str, following: str, start: int = 0) -> DataFrame:
    """The events of each session that are accepted: those whose expected cursor is the session's, which each accepted event moves on to `following`.

    A session is folded inside one aggregate, over its events alone.
    """
    events = F.array_sort(F.collect_list(F.struct(*order, F.col(expected).alias("_expected"), F.col(following).alias("_next"))))
    state = F.struct(F.lit(start).cast("bigint").alias("cursor"), F.lit(0).cast("bigint").alias("accepted"), F.lit(0).cast("bigint").alias("stale"))

    def step(s: Column, e: Column) -> Column:
        fits = e["_expected"] == s["cursor"]
        return F.struct(F.when(fits, e["_next"].cast("bigint")).otherwise(s["cursor"]).alias("cursor"), (s["accepted"] + fits.cast("bigint")).alias("accepted"), (s["stale"] + (~fits).cast("bigint")).alias("stale"))

    return log.groupBy(key).agg(F.aggregate(events, state, step).alias("_s")).select(key, "_s.*")


def unique_markers(log: DataFrame, key: str, order: str, value: str, out: str = "markers") -> DataFrame:
    """For each session its distinct values in the order in which they first came."""
    firsts = log.groupBy(key, value).agg(F.min(order).alias("_first"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias(out))


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each session: what an upsert leaves."""
    rest = [c for c in log.columns if c != key and c not in order]
    return log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(key, "_r.*")


def expired(log: DataFrame, key: str, seen: str, now: Column, idle: str = "15 minutes") -> DataFrame:
    """Sessions with the time of their last event and whether they have been idle for too long at `now`, an expression that is the same for all rows."""
    return log.groupBy(key).agg(F.max(seen).alias("last_seen"), F.max(now).alias("_now")).withColumn("expired", F.col("last_seen") < F.col("_now") - F.expr(f"interval {idle}")).drop("_now")


def sessions(log: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """log with the number of each event's session: a new one begins after a gap of at least gap_seconds. Batch twin of the streaming session window."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)) >= gap_seconds * 1_000_000
    return log.withColumn("session", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))


def counters(answers: DataFrame, key: str, group: str, correct: str, practice: Column) -> DataFrame:
    """Right and wrong answers of each session in each group; practice items are not counted."""
    counted = answers.where(~practice)
    return counted.groupBy(key, group).agg(F.count_if(F.col(correct)).alias("right_answers"), F.count_if(~F.col(correct)).alias("wrong_answers"))


def block(item: Column, size: int = 7, practice: int = 2) -> dict[str, Column]:
    """The block of an item: its number, first and last item, and whether the item is practice."""
    number = F.floor(item / size).cast("bigint")
    return {"block": number, "first_item": number * size, "end_item": number * size + size, "practice": item % size < practice}


def connections(log: DataFrame, key: str, order: list[str], kind: str = "kind", payload: str = "payload") -> DataFrame:
    """(key, initialized, closed, payload, rehydrated, refused): what the events of a connection leave.

    `initialize` keeps its payload and opens, `close` closes, `rehydrate` counts only while it is initialized and open and is refused otherwise; all other
    kinds say only that it was seen. A connection's events are folded in one aggregate.
    """
    events = F.array_sort(F.collect_list(F.struct(*order, F.col(kind).alias("_kind"), F.col(payload).cast("string").alias("_payload"))))
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    start = F.struct(no.alias("initialized"), no.alias("closed"), F.lit(None).cast("string").alias("payload"), zero.alias("rehydrated"), zero.alias("refused"))

    def step(s: Column, e: Column) -> Column:
        opens, again = F.coalesce(e["_kind"] == "initialize", no), F.coalesce(e["_kind"] == "rehydrate", no)
        fits = again & s["initialized"] & ~s["closed"]
        return F.struct(
            (s["initialized"] | opens).alias("initialized"), F.when(opens, no).when(e["_kind"] == "close", F.lit(True)).otherwise(s["closed"]).alias("closed"),
            F.when(opens, e["_payload"]).otherwise(s["payload"]).alias("payload"), (s["rehydrated"] + fits.cast("bigint")).alias("rehydrated"), (s["refused"] + (again & ~fits).cast("bigint")).alias("refused"),
        )

    return log.groupBy(key).agg(F.aggregate(events, start, step).alias("_s")).select(key, "_s.*")
