"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The leaves of the tree are (domain, language, source). A leaf can give its tokens as often as epochs are allowed. The total
budget is divided from the root down: at each node in proportion to its children's weights, but no child gets more than its
whole subtree can give; what it can't take goes to its siblings by their weights, and reaches the siblings of
an ancestor only if the whole family is short, as each family's share was bounded by what it can give. A leaf takes full
epochs of its documents, and of one more epoch, in that epoch's seeded order, the documents that fit whole into the rest.

Amounts are integers throughout. The running sum over a leaf's order is made in two steps, over ranges of the order and within
each, so a source with a third of all rows is no single task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, row_key, unused

#: Documents in a range of a leaf's order, about.
RANGE_ROWS = 2048


@dataclass(frozen=True)
class Plan:
    """What to mix. Weights are whole numbers, compared among siblings only; names that are not listed get `other`.

    Weight 0 leaves a name out: nothing below it is taken, and what it would get goes to its siblings.
    """

    domain_weights: dict[str, int] = field(default_factory=dict)
    lang_weights: dict[str, int] = field(default_factory=dict)
    source_weights: dict[str, int] = field(default_factory=dict)
    other: int = 1
    #: The budget as a share of all tokens, in thousandths; or the number of tokens.
    per_mille: int | None = 600
    tokens: int | None = None
    epochs: int = 2
    seed: int = 42

    def __post_init__(self):
        if min([self.other, *self.domain_weights.values(), *self.lang_weights.values(), *self.source_weights.values()]) < 0:
            raise ValueError("weights must not be negative")


def default_domain(source: Column) -> Column:
    """The domain of a source that is told by the last digit of its name."""
    digit = F.regexp_extract(source, "([0-9])$", 1)
    return F.when(digit.isin("0", "1", "2"), "web").when(digit.isin("3", "4", "5"), "books").when(digit.isin("6", "7"), "forums").when(digit.isin("8", "9"), "reference").otherwise("other")


def n_tokens(text: Column) -> Column:
    """Words of a text, as its measure of tokens; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text.cast("string"), f"{SPACE_CLASS}+"), "")), F.lit(0)).cast("bigint")


def _weight(name: str, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for value, w in weights.items():
        out = F.when(F.col(name) == value, F.lit(w)).otherwise(out)
    return F.coalesce(out, F.lit(other)).cast("decimal(38,0)")


def _share(nodes: DataFrame, parent: list[str], name: str, budget: str, out: str) -> DataFrame:
    """nodes (parent, name, capacity, weight, and the parent's budget) with each one's part of its parent's budget.

    A child is full if its capacity is at most its weight's part of what is left after all children with less capacity for their weight.
    """
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # Weight 0 goes with capacity 0.
    ratio = F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.greatest(F.col("weight"), F.lit(1)).cast("double")).otherwise(F.lit(0.0))
    order = family.orderBy("_ratio", "_name")
    left = nodes.withColumn("_ratio", ratio).withColumn("_name", F.coalesce(F.concat(F.lit("="), name), F.lit("")))
    left = left.withColumn("_before", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)"))
    left = left.withColumn("_weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(38,0)")).withColumn("_place", F.row_number().over(order))
    rest = F.greatest(F.col(budget) - F.col("_before"), F.lit(0).cast("decimal(38,0)"))
    full = F.col("capacity") * F.col("_weights") <= F.col("weight") * rest
    left = left.withColumn("_open", F.min(F.when(~full, F.struct("_place", rest.alias("rest"), F.col("_weights").alias("weights")))).over(family))
    part = F.when(F.col("_open").isNull() | (F.col("_place") < F.col("_open._place")), F.col("capacity")).otherwise(F.expr("(weight * _open.rest) div _open.weights").cast("decimal(38,0)"))
    return left.withColumn(out, part.cast("decimal(38,0)")).drop("_ratio", "_name", "_before", "_weights", "_place", "_open")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves (domain, lang, source, tokens, rows) with `budget`: how many tokens each gives, repeats included."""
    given = (_weight("domain", plan.domain_weights, plan.other) > 0) & (_weight("lang", plan.lang_weights, plan.other) > 0) & (_weight("source", plan.source_weights, plan.other) > 0)
    leaves = leaves.withColumn("capacity", F.when(given, F.col("tokens")).otherwise(F.lit(0)).cast("decimal(38,0)") * F.lit(plan.epochs)).withColumn("capacity", F.col("capacity").cast("decimal(38,0)"))
    wanted = F.lit(plan.tokens).cast("decimal(38,0)") if plan.tokens is not None else F.expr(f"(cast(sum(tokens) as decimal(38,0)) * {int(plan.per_mille)}) div 1000").cast("decimal(38,0)")
    root = leaves.agg(F.least(wanted, F.sum("capacity").cast("decimal(38,0)")).alias("root_budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").cast("decimal(38,0)").alias("capacity"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").cast("decimal(38,0)").alias("capacity"))
    domains = domains.withColumn("weight", _weight("domain", plan.domain_weights, plan.other)).join(F.broadcast(root), F.lit(True))
    domains = _share(domains, [], "domain", "root_budget", "domain_budget").select("domain", "domain_budget")
    langs = langs.withColumn("weight", _weight("lang", plan.lang_weights, plan.other)).join(domains, "domain")
    langs = _share(langs, ["domain"], "lang", "domain_budget", "lang_budget").select("domain", F.col("lang").alias("_lang"), "lang_budget")
    leaves = leaves.alias("l").join(langs.alias("g"), (F.col("l.domain") == F.col("g.domain")) & F.col("l.lang").eqNullSafe(F.col("g._lang"))).select("l.*", "g.lang_budget")
    leaves = leaves.withColumn("weight", _weight("source", plan.source_weights, plan.other))
    return _share(leaves, ["domain", "lang"], "source", "lang_budget", "budget").select("domain", "lang", "source", "tokens", "rows", F.col("budget").cast("bigint").alias("budget"))


def copies(docs: DataFrame, plan: Plan, id_col: str = "doc_id", domain=default_domain) -> DataFrame:
    """One row for each row of docs: doc_id, row_key, domain, lang, source, n_tokens, budget (its leaf's) and copies, how often it is taken.

    Null languages and sources are leaves of their own. Documents without tokens are taken in full epochs only, and in the last one if it reaches them.
    Repeated rows are separate documents, in an order among them that changes nothing in the result. Rows without an id are ordered by their contents.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(docs).alias("row_key"), domain(F.col("source")).alias("domain"), "lang", "source", n_tokens(F.col("text")).alias("n_tokens"))
    rows = cut(rows)
    leaves = rows.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    given = budgets(leaves, plan)
    # Whole epochs, what is left for one more, and into how many ranges of its order a leaf is cut.
    given = given.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    given = given.select(F.col("domain").alias("_domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "budget", "whole", "rest", F.ceil(F.col("rows") / RANGE_ROWS).alias("ranges"))
    at = rows.join(given, F.col("domain").eqNullSafe(F.col("_domain")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_domain", "_lang", "_source")
    at = at.withColumn("_order", F.md5(F.concat_ws(":", F.lit(plan.seed), (F.col("whole") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row"), F.col("row_key").cast("string"))))))
    at = at.withColumn("_range", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("bigint") * F.col("ranges") / F.lit(1 << 32)))
    at = at.withColumn("_leaf", F.xxhash64("domain", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    at = cut(at)
    sums = at.groupBy("_leaf", "_range").agg(F.sum("n_tokens").alias("_sum"))
    earlier = Window.partitionBy("_leaf").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_leaf", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_leaf", "_range").orderBy("_order", "doc_id", "n_tokens", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("n_tokens").over(within)
    return at.join(sums, ["_leaf", "_range"]).select("doc_id", "row_key", "domain", "lang", "source", "n_tokens", "budget", (F.col("whole") + (upto <= F.col("rest")).cast("bigint")).alias("copies"))


def mixed(docs: DataFrame, plan: Plan, id_col: str = "doc_id", domain=default_domain) -> DataFrame:
    """The rows of docs, each as often as the plan takes it, with docs' columns."""
    of_id, key, times = unused(docs, "_id", "_key", "_copies")
    none = F.lit(-(2**63))
    taken = copies(docs, plan, id_col, domain).where("copies > 0")
    taken = taken.groupBy(F.coalesce("doc_id", none).alias(of_id), F.col("row_key").alias(key)).agg(F.sum("copies").cast("int").alias(times))
    # Rows that are equal in all columns have one key: one of them stands for all, with all their copies.
    single = docs.select("*", F.coalesce(F.col(id_col).cast("bigint"), none).alias(of_id), row_key(docs).alias(key)).dropDuplicates([of_id, key])
    return single.join(taken, [of_id, key]).withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))
