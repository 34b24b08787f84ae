"""Language identification by hierarchical discrimination.

A first linear classifier predicts the family of languages; within a family, one-versus-one linear support vector machines tell its
languages apart by vote. All of them read hashed byte trigrams of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, in_parts, tidy
from .ngrams import letter_classes, trigram_counts

#: Families of closely related languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "finnic": ("et", "fi"),
    "turkic": ("az", "kk", "tr", "uz"),
}
BUCKETS = 4096
_CLASSES = letter_classes()
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    """fit_rows bounds the labelled rows that are learnt from, in equal parts for each language, at least one of each."""

    fit_rows: int = 2400
    steps: int = 150
    penalty: float = 1e-4


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"={lang}")


def features(text: str | None) -> np.ndarray:
    """Square roots of trigram shares: a unit vector for every text with a trigram."""
    counts = trigram_counts(text, _CLASSES, BUCKETS)
    return np.sqrt(counts / max(int(counts.sum()), 1)).astype(np.float32)


def _machine(x: np.ndarray, y: np.ndarray, settings: Settings) -> np.ndarray:
    """A linear support vector machine (squared hinge) for labels 1 and -1; the last weight is the offset. Accelerated gradient descent from zero, both classes weighted alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    cost = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = 1.0 / (2 * float((cost * (x * x).sum(axis=1)).sum()) + settings.penalty)
    for i in range(settings.steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (settings.penalty * v - 2 * ((cost * y * slack) @ x))
        v = new + i / (i + 3) * (new - w)
        w = new
    return w.astype(np.float32)


@dataclass
class Model:
    """Weights of the family classifiers (one against the rest) and of the machines between each two languages of a family; its size depends on the number of languages only."""

    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray
    pairs: dict[str, list[tuple[int, int]]]
    pair_weights: dict[str, np.ndarray]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score for each text; `und` and 0 for texts without a letter, or if nothing was learnt."""
        lettered = [bool(self.families and t and _LETTER.search(t)) for t in texts]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        on = np.flatnonzero(lettered)
        if not len(on):
            return langs, scores
        x = np.hstack([np.stack([features(texts[i]) for i in on]), np.ones((len(on), 1), np.float32)])
        margins = x @ self.family_weights.T
        best = margins.argmax(axis=1)
        sure = _chance(margins[np.arange(len(on)), best]) if len(self.families) > 1 else np.ones(len(on))
        for f, name in enumerate(self.families):
            mine = np.flatnonzero(best == f)
            if not len(mine):
                continue
            names = self.members[name]
            votes = np.zeros((len(mine), len(names)))
            chances = np.zeros((len(mine), len(names)))
            for (a, b), w in zip(self.pairs[name], self.pair_weights[name]):
                m = x[mine] @ w
                p = _chance(m)
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                chances[:, a] += p
                chances[:, b] += 1 - p
            pick = (votes + chances / (len(names) + 1)).argmax(axis=1)
            within = chances[np.arange(len(mine)), pick] / max(len(names) - 1, 1) if len(names) > 1 else np.ones(len(mine))
            for i, p, s in zip(on[mine], pick, sure[mine] * within):
                langs[i], scores[i] = names[p], float(min(max(s, 0.0), 1.0))
        return langs, scores


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3 * margin.astype(np.float64)))


def fit(labelled: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with an id, a language and a text with a letter; each text is learnt under the language of its own row.

    Of each language the rows with the least hash of their id are taken, up to its part of fit_rows. A language none of whose rows taken
    has a letter is not learnt. With nothing to learn from, the model predicts `und` for all texts.
    """
    picked = bounded_rows(labelled, None, id_col, lang_col, text_col, settings.fit_rows)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 1):
                texts = part.column(1).to_pylist()
                on = pa.array([bool(t and _LETTER.search(t)) for t in texts], pa.bool_())
                x = pa.array([features(t).tobytes() for t, lettered in zip(texts, on.to_pylist()) if lettered], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(on), part.column(2).filter(on), x], names=["h", "lang", "x"])

    got = picked.select("h", "text", F.col("label").alias("lang")).repartition(8, "h").mapInArrow(work, "h bigint, lang string, x binary").toPandas().sort_values(["lang", "h", "x"], kind="stable")
    if not len(got):
        return Model([], {}, np.zeros((0, BUCKETS + 1), np.float32), {}, {})
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]])
    lang = got["lang"].to_numpy()
    fam = np.array([family(v) for v in lang])
    families = sorted(set(fam))
    members = {f: sorted(set(lang[fam == f])) for f in families}
    first = np.stack([_machine(x, np.where(fam == f, 1, -1).astype(np.float32), settings) if len(families) > 1 else np.zeros(BUCKETS + 1, np.float32) for f in families])
    pairs = {f: [*combinations(range(len(m)), 2)] for f, m in members.items()}
    between = {}
    for f, m in members.items():
        weights = []
        for a, b in pairs[f]:
            on = (lang == m[a]) | (lang == m[b])
            weights.append(_machine(x[on], np.where(lang[on] == m[a], 1, -1).astype(np.float32), settings))
        between[f] = np.stack(weights) if weights else np.zeros((0, BUCKETS + 1), np.float32)
    return Model(families, members, first, pairs, between)


def predicted(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, lang_pred and score. Repeated rows stay; null texts and texts without a letter are `und` with score 0."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 1):
                langs, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(work, "doc_id bigint, lang_pred string, score double")
