"""The registered queries of this folder: each reads its whole table and passes it through its operator, and adds the columns asked for."""

from __future__ import annotations

from dataclasses import replace

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, html, language, mixing, quality, rules, secrets, simhash
from .common import held_out, table
from .oracles import RULES_SQL, SECRETS_SQL, mixing_sql

#: The mix that the registered query and the pipeline aim at.
MIX = mixing.Plan(domain_weights={"web": 40, "books": 25, "forums": 20, "reference": 15}, lang_weights={"en": 50, "de": 20, "fr": 20, "es": 10}, other=5, per_mille=600, epochs=2, seed=42)


def byte_bpe() -> bytes:
    """The content of the byte-level tokenizer file; the file is part of the Python environment of driver and executors."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


def op1_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose vec_id is divisible by 20, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Rows of one id with contrary labels say nothing.
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_most")).where("label = _most")
    model = quality.fit(docs, labels.where(~held_out("doc_id", 4, 2)))
    out = quality.scored(docs, model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict of the threshold table for all documents."""
    out = rules.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("rules.metrics")
    return out.select("doc_id", *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col("rules.base_failed").alias("base_failed"), F.col("rules.kept").alias("kept"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.copies(table(spark, sf_dir, "documents"), MIX).drop("row_key")


def _findings(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, without a ledger: every blob is new."""
    found, _ = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _findings(found)


def secret_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 with a ledger of all documents in which one rule's version is out of date: only that rule is scanned again, and the findings are those of a full scan."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    older = tuple(replace(r, version=0, least=64) if r.kind == "hex" else r for r in secrets.RULES)
    _, ledger = secrets.scan(docs, rules=older)
    found, _ = secrets.scan(docs, ledger)
    return _findings(found)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    out = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    out = html.extracted(table(spark, sf_dir, "pages"), "html", "text", "page_id", "url")
    return out.select("page_id", "url", "text", "n_chars")


def transcripts_text() -> Column:
    """A turn of `conversations` as raw transcripts show it: the role is told by a marker in one of several styles, and left out of every fifth turn."""
    style, role = F.pmod(F.xxhash64("conv_id"), F.lit(4)), F.col("role")
    human = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise(F.initcap("role"))
    marked = F.when(style == 0, F.concat(F.initcap("role"), F.lit(": "), "text")).when(style == 1, F.concat(F.lit("### "), human, F.lit(":\n"), "text"))
    marked = marked.when(style == 2, F.concat(F.lit("["), role, F.lit("]\n"), "text")).otherwise(F.concat(F.lit("<|"), role, F.lit("|>"), "text"))
    bare = role.isNull() | (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0)
    return F.when(bare, F.col("text")).otherwise(marked)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all conversations, read back from raw transcripts; the model is counted from conversations that are not held out."""
    talks = table(spark, sf_dir, "conversations")
    raw = talks.select("conv_id", "turn", "role", transcripts_text().alias("text"))
    model = chat.fit(raw.where(~held_out("conv_id", 4, 2)), "role")
    return chat.turns(raw.drop("role"), model)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of all documents."""
    return bpe.digests(table(spark, sf_dir, "documents"), byte_bpe())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang").where(~held_out("doc_id", 3, 1)))
    return language.predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_vector_graph, op2_quality_classifier, op3_quality_rules, op4_mixing, op5_secret_scan, op6_simhash_dedup, op7_main_text, op8_chat_format, op9_bpe, op10_language_id, secret_rescan)}
ORACLES = {"op3_quality_rules": RULES_SQL, "op4_mixing": mixing_sql(MIX), "op5_secret_scan": SECRETS_SQL, "secret_rescan": SECRETS_SQL}
