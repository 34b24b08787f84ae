"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, bind, unused

SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the they this to was were what when who will with "
    "als am auch auf aus bei das dass dem den der des die ein eine einer er es für im ist mit nach nicht sich sie sind und von werden wie wird zu "
    "au aux avec ce cette dans de des du elle en est et il la le les mais ne pas plus pour qui que sa se son sur un une "
    "al como con del el ella en entre es esta está la las lo los más muy no o para pero por que se sin su sus un una y"
)


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: a text is rejected if metric is below `least` or above `most`."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: Read off the labelled texts at sf0.1 that pass the base rules: all 3,243 good ones stay, in each of four languages, and none of the 291 others. There
#: is no upper limit of length.
RULES = (
    Rule("length", "n_words", least=50),
    Rule("word_length", "mean_word_chars", least=2, most=15),
    Rule("symbols", "symbol_ratio", most=0.06),
    Rule("shouting", "upper_ratio", most=0.30),
    Rule("exclamations", "exclamation_ratio", most=0.20),
    Rule("repeats", "repeat_ratio", most=0.50),
    Rule("stop_words", "stop_ratio", least=0.06),
    Rule("duplicate_lines", "dup_line_ratio", most=0.50),
    Rule("bullets", "bullet_ratio", most=0.90),
    Rule("ellipses", "ellipsis_ratio", most=0.30),
)


def _count(text: Column, pattern: str) -> Column:
    """Characters of text that match; most texts hold few, so taking them out costs little more than a scan."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def _repeat_words(words: Column) -> Column:
    """Words that stand in a window of three words found twice or more in the text.

    Most texts repeat few windows or none, which a sort of bare hashes shows; where there are more than a handful, hashes are sorted with their
    places. The windows whose hash comes up twice are then compared by their words, so the count is exact.
    """
    n, few = F.size(words), 6

    def same_words(at: Column) -> Column:
        """Of the places at, in order, those whose window stands at another of them too."""
        window = lambda p: F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))
        twice = lambda s, x, j: F.coalesce(x["w"] == F.get(s, j - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, j + 1)["w"], F.lit(False))
        by_window = F.sort_array(F.transform(at, lambda p: F.struct(window(p).alias("w"), p.alias("i"))))
        return bind(by_window, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: twice(s, x, j)), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"), lambda total, x: total + x)

    def places(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def placed(windows: Column) -> Column:
        return F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def counted(windows: Column, twice: Column) -> Column:
        some = F.transform(F.filter(placed(windows), lambda x: F.array_contains(twice, x["h"])), lambda x: x["i"])
        many = bind(F.sort_array(placed(windows)), places)
        return F.when(F.size(twice) == 0, F.lit(0).cast("bigint")).otherwise(bind(bind(F.when(F.size(twice) <= few, some).otherwise(many), same_words), covered))

    def of(windows: Column) -> Column:
        twice = bind(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda h, j: F.coalesce(h == F.get(s, j + 1), F.lit(False)))))
        return bind(twice, lambda t: counted(windows, t))

    return bind(F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), of)


def metrics(text: Column) -> Column:
    """One struct with all that the rules measure. A null text counts as empty; ratios of nothing are 0."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    stop = sorted(set(STOP_WORDS.split()))

    def counted(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"), F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            _count(text, SYMBOLS).alias("n_symbols"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"), F.size(lines).alias("n_lines"),
            _count(text, r"\p{Lu}").alias("upper"), _count(text, "!").alias("exclamations"),
            F.size(F.filter(words, lambda w: w.isin(stop))).alias("stops"),
            F.size(F.filter(lines, lambda l: l.rlike(r"^\s*[-*•·|]"))).alias("bullets"), F.size(F.filter(lines, lambda l: l.rlike(r"(\.\.\.|…)\s*$"))).alias("ellipses"),
        )

    def measured(c: Column) -> Column:
        per = lambda x, of: F.when(c[of] > 0, c[x] / c[of]).otherwise(F.lit(0.0))
        return F.struct(
            *(c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            per("word_chars", "n_words").alias("mean_word_chars"), per("n_symbols", "word_chars").alias("symbol_ratio"), per("upper", "word_chars").alias("upper_ratio"),
            per("exclamations", "n_words").alias("exclamation_ratio"), per("n_repeat_words", "n_words").alias("repeat_ratio"), per("stops", "n_words").alias("stop_ratio"),
            per("n_dup_lines", "n_lines").alias("dup_line_ratio"), per("bullets", "n_lines").alias("bullet_ratio"), per("ellipses", "n_lines").alias("ellipsis_ratio"),
        )

    words = F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    return bind(words, lambda w: bind(lines, lambda l: bind(counted(w, l), measured)))


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a text fails, in the table's order."""
    failed = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (m[r.metric] < r.least)
        if r.most is not None:
            bad = bad | (m[r.metric] > r.most)
        failed.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*failed))


def scored(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, out_col: str = "rules") -> DataFrame:
    """df with a struct out_col appended: metrics, failed (names of rules), base_failed and kept. An existing column of that name is replaced."""
    base = lambda m: (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    out = bind(metrics(F.col(text_col)), lambda m: bind(verdict(m, rules), lambda f: F.struct(m.alias("metrics"), f.alias("failed"), base(m).alias("base_failed"), (~base(m) & (F.size(f) == 0)).alias("kept"))))
    return df.withColumn(out_col, out)


def filtered(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that pass, with df's columns."""
    (found,) = unused(df, "_rules")
    return scored(df, text_col, rules, found).where(f"{found}.kept").select(*(F.col(f"`{c}`") for c in df.columns))
