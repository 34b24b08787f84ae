"""A quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its words (hashed), its byte trigrams by style of character, and counts of its repeats. Latent-semantic analysis (term weights
by inverse document frequency, then a truncated singular value decomposition) turns them into short vectors. The labelled
vectors are broadcast; every document's cosines with all of them are computed exactly, in blocks, and the nearest ones vote, each
weighted by its similarity.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, in_parts, tidy
from .ngrams import shape_classes, trigram_counts

SHAPES = 16
#: Buckets that words are hashed to.
WORDS = 2048
#: Trigrams, then pseudo-terms for what trigrams don't show, then words.
STYLES, REPEATS = SHAPES**3, 4
TERMS = STYLES + REPEATS + WORDS
_CLASSES = shape_classes()


@dataclass(frozen=True)
class Settings:
    """fit_rows bounds the labelled rows that are learnt from, half of each label as far as there are so many; it also bounds what is broadcast."""

    fit_rows: int = 3000
    rank: int = 48
    neighbours: int = 15
    power: float = 4.0


def terms(text: str | None) -> np.ndarray:
    """Term counts of a whole text. Texts without trigrams have none."""
    text = text or ""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    out = np.zeros(TERMS, np.float32)
    out[:STYLES] = trigram_counts(text, _CLASSES, STYLES, SHAPES)
    if not words:
        return out
    twice = sum(map(str.__eq__, words, words[1:]))
    counts = Counter(words)
    # Repeats are put on the scale of trigrams, of which a word has about six.
    out[STYLES : STYLES + REPEATS] = 6 * twice, 30 * (len(lines) - len(set(lines))), 6 * (len(words) - len(counts)), len(words)
    at = np.fromiter((xxhash.xxh32_intdigest(w.lower().encode("utf-8", "surrogatepass")) for w in counts), np.int64, len(counts)) % WORDS
    out[STYLES + REPEATS :] = np.bincount(at, np.fromiter(counts.values(), np.float64, len(counts)), WORDS)
    return out


@dataclass
class Model:
    """What is broadcast: term weights, the projection, and the labelled vectors; bounded by the settings, whatever the corpus."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    settings: Settings

    def embed(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of texts, from their term counts; zero for texts without terms."""
        return _unit((_weighted(counts) * self.idf) @ self.basis)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """For each text the share of its neighbours' votes that is for label 1; 0.5 if no neighbour is similar at all. Among equals in the ninth decimal the first rows vote."""
        cosines = np.rint((self.embed(counts) @ self.vectors.T) * 1e9).astype(np.int64)
        k = min(self.settings.neighbours, cosines.shape[1])
        # The row's place is put behind the cosine, so that no two keys are equal.
        places = np.arange(cosines.shape[1])[::-1]
        at = np.argpartition(-(cosines << 24 | places), k - 1, axis=1)[:, :k]
        at.sort(axis=1)
        weight = np.maximum(np.take_along_axis(cosines, at, 1) / 1e9, 0.0) ** self.settings.power
        total = weight.sum(axis=1)
        votes = (weight * self.labels[at]).sum(axis=1)
        return np.where(total > 0, np.minimum(votes / np.where(total > 0, total, 1), 1.0), 0.5)


def _weighted(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares, of trigrams and of words: frequent terms are damped, and length plays no part."""
    share = counts.astype(np.float64)
    share[:, : STYLES + REPEATS] /= np.maximum(share[:, :STYLES].sum(axis=1, keepdims=True), 1)
    share[:, STYLES + REPEATS :] /= np.maximum(share[:, STYLES + REPEATS :].sum(axis=1, keepdims=True), 1)
    return np.sqrt(share)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> Model:
    """Learn from the texts of docs and the labels (0 or 1; others and nulls are passed over), joined by id. Of each label, the ids with the least hash are taken, up to half of fit_rows."""
    known = labels.select(id_col, F.col(label_col).cast("int").alias(label_col)).where(F.col(label_col).isin(0, 1))
    rows = bounded_rows(known, docs, id_col, label_col, text_col, settings.fit_rows)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 1):
                counts = [zlib.compress(terms(t.as_py()).tobytes(), 1) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.binary())], names=["h", "label", "counts"])

    got = rows.repartition(8, "h").mapInArrow(work, "h bigint, label int, counts binary").toPandas().sort_values(["label", "h", "counts"], kind="stable")
    if not len(got):
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((1, 1)), np.zeros(1), settings)
    x = _weighted(np.stack([np.frombuffer(zlib.decompress(c), np.float32) for c in got["counts"]]))
    idf = 1 + np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0)))
    x *= idf
    basis = _right_vectors(x, settings.rank)
    return Model(idf, basis, _unit(x @ basis), got["label"].to_numpy(np.float64), settings)


def _right_vectors(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of x as columns, by subspace iteration from a fixed start; as many as x can have, if it has fewer rows."""
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 16, *x.shape))))[0]
    for _ in range(8):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, w = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ w.T)[:, :rank])


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id and score (0 to 1). Empty and null texts have no terms and score 0.5, as do all if there was nothing to learn from. Repeated rows stay."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in in_parts(batch, 1):
                score = m.score(np.stack([terms(t.as_py()) for t in part.column(1)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(work, "doc_id bigint, score double")
