"""Secret scans over an incremental ledger of blobs, in DataFrame operations only.

Every historical version of every path is content-addressed (SHA-256). The ledger holds one row for each blob and rule
version that was ever scanned, with its findings. A scan looks only at pairs that the ledger lacks, and joins what
it then knows back to all paths. Adding a rule, or changing a rule's version, rescans every blob for that rule alone.

A regular expression function gives matches without their places; the places follow from cutting the text at
the same expression: what lies between the matches and the matches themselves alternate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, cut, unused


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, left to right without overlap, of which those stay whose group has at least `least` characters.

    hint is a cheaper pattern that every text with a finding matches.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None


#: In the order in which findings at the same place are listed.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    # Runs of 32 and more are the runs that are long enough; shorter ones need no look.
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh[pousr]_"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    Rule("google", 1, r"AIza[0-9A-Za-z_-]{35}", 0, 39, "AIza"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*", 0, 24, "eyJ"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?", 0, 20, "PRIVATE KEY"),
)
SPAN = "array<struct<start:bigint,end:bigint,kind:string>>"


def spans(text: Column, rule: Rule) -> Column:
    """The findings of one rule in text: array of (start, end, kind), in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    zero = F.lit(0).cast("bigint")

    def placed(between: Column, whole: Column, group: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast(SPAN).alias("found"))

        def step(state: Column, i: Column) -> Column:
            begin = state["at"] + F.length(F.get(between, i))
            long_enough = F.length(F.get(group, i)) >= rule.least

            def after(b: Column) -> Column:
                end = (b + F.length(F.get(whole, i))).cast("bigint")
                span = F.struct(b.cast("bigint").alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"))
                return F.struct(end.alias("at"), F.when(long_enough, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

            return bind(begin, after)

        return F.aggregate(F.sequence(F.lit(0), F.size(whole) - 1), start, step, lambda s: s["found"])

    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    found = bind(F.split(text, rule.pattern, -1), lambda b: bind(whole, lambda w: bind(group, lambda g: placed(b, w, g))))
    hinted = text.rlike(rule.pattern) if rule.hint is None else text.rlike(rule.hint) & text.rlike(rule.pattern)
    return F.when(hinted, found).otherwise(F.array().cast(SPAN))


def scan(
    history: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES, blob_col: str = "blob", spans_col: str = "spans", broadcast_blobs: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """(findings, news): history's rows and columns with blob_col (the text's address) and spans_col; and the rows to add to the ledger.

    history has a row for each version of each path; a null text counts as empty. ledger has (blob, kind, version, spans), one row for each blob and
    rule version that was ever scanned. Repeated rows stay repeated; texts that are equal are scanned once. Spans are sorted by start, then by the
    rules' order. Columns of history called blob_col or spans_col are replaced; pass other names to keep them.

    With a ledger, addresses are compared first, and only texts of blobs that lack a rule version are shuffled and scanned.
    """
    b_, t_, s_ = unused(history, "_blob", "_text", "_spans")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    addressed = history.withColumn(b_, F.sha2(text, 256))
    texts = addressed.select(F.col(b_).alias("blob"), text.alias("text"))
    pair = lambda kind, version: F.concat_ws(":", kind, version)
    wanted = [f"{r.kind}:{r.version}" for r in rules]
    known = None
    if ledger is None:
        blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    else:
        known = ledger.where(pair("kind", "version").isin(wanted)).select("blob", "kind", "version", "spans").dropDuplicates(["blob", "kind", "version"])
        seen = known.groupBy("blob").agg(F.collect_set(pair("kind", "version")).alias("seen"))
        lacking = texts.select("blob").distinct().join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))).where(F.size("seen") < len(wanted))
        lacking = cut(lacking)
        few = lacking.count() <= broadcast_blobs
        blobs = texts.join(F.broadcast(lacking.select("blob")) if few else lacking.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
        blobs = blobs.join(lacking, "blob")

    def unseen(r: Rule) -> Column:
        found = spans(F.col("text"), r)
        return found if known is None else F.when(F.array_contains("seen", f"{r.kind}:{r.version}"), F.lit(None)).otherwise(found)

    # What a scan finds is written down once, for the findings and for the ledger. The join back then meets files instead of an
    # aggregate, so that Spark can split the task of a blob that very many paths share.
    fresh = cut(blobs.select("blob", *(unseen(r).alias(r.kind) for r in rules)))
    rows = fresh.select("blob", F.explode(F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules))).alias("row")).select("blob", "row.*").where("spans is not null")
    if known is None:
        found = fresh.select("blob", F.concat(*(F.col(r.kind) for r in rules)).alias("spans"))
    else:
        both = known.unionByName(rows).where(F.size("spans") > 0)
        found = both.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    ranked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    in_order = F.transform(F.array_sort(ranked), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    # Blobs without findings need no row to be joined with: there are few findings, whatever the input.
    found = found.where(F.size("spans") > 0).select(F.col("blob").alias(b_), in_order.alias(s_))
    out = addressed.join(found, b_, "left").withColumn(s_, F.coalesce(s_, F.array().cast(SPAN)))
    kept = [c for c in history.columns if c.lower() not in (blob_col.lower(), spans_col.lower())]
    return out.select(*(F.col(f"`{c}`") for c in kept), F.col(b_).alias(blob_col), F.col(s_).alias(spans_col)), rows


def scan_with_ledger(history: DataFrame, path: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of scan, by the ledger at path (Parquet; made if it is not there), to which what was scanned is added."""
    spark = history.sparkSession
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)
    findings, rows = scan(history, spark.read.parquet(path) if there else None, text_col, rules)
    rows.write.mode("append").parquet(path)
    return findings


def masked(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """text with every stretch that findings cover replaced by mask; findings that overlap or touch give one mask."""

    def step(state: Column, s: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        out = F.when(s["start"] > state["at"], F.concat(state["out"], between, F.lit(mask))).when((state["at"] == 0) & (s["start"] == 0), F.lit(mask))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    end = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, end)).otherwise(text)


def redacted(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, length_col: str | None = None) -> DataFrame:
    """df with the secrets in its texts masked; all rows and columns stay. Null texts stay null. length_col, if given and there, is set to the new length where a text was changed."""
    blob, found = unused(df, "_address", "_found")
    out, _ = scan(df, None, text_col, rules, blob, found)
    out = out.withColumn(text_col, masked(F.col(f"`{text_col}`"), F.col(found)))
    if length_col in df.columns:
        out = out.withColumn(length_col, F.when(F.size(found) > 0, F.length(text_col).cast(df.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*(F.col(f"`{c}`") for c in df.columns))
